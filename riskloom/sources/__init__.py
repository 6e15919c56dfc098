"""Readers, writers and the scoring frames."""
