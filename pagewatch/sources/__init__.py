"""Readers, table merges and sinks."""
