"""Structured Streaming jobs for continuous intake."""
