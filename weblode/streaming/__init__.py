"""Structured Streaming forms of the event folds."""
