"""Stateful counterparts on Structured Streaming."""
