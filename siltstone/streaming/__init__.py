"""Streams and incremental views."""
