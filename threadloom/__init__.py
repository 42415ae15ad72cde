"""A Spark library of transcript operators."""
