"""Streaming forms of the serving analytics."""
