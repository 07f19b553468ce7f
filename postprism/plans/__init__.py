"""Composed analyses: each takes a Star (or two) and returns the result table."""
