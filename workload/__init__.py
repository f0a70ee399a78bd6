"""The library's operators applied to the given tables, and their equivalents in SQL."""
