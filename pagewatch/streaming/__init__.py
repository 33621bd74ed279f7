"""Incremental versions of the history operators on Structured Streaming."""
