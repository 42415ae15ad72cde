"""Column functions on text, times and paths."""
