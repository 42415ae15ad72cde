"""Incremental and micro-batch refresh."""
