"""Whole studies put together from the operators."""
