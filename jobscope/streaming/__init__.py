"""Structured Streaming form of the end-state report over an arriving job log."""
