"""Operators for preparing training data: each module holds one operator, `queries` binds them to the tables."""
