"""Structured Streaming jobs over the journal, progress, messages and uploads."""
