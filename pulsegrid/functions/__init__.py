"""Scalar helpers: pure Column expressions and the Python arithmetic of intervals."""
