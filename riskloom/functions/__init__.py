"""Column expressions and distribution functions."""
