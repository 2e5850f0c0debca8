"""Column expressions over DNA strings and search hits."""
