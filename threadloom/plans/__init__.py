"""Named queries over tables, with the SQL that says the same."""
