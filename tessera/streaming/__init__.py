"""Streams: retrieval for entities as their features arrive."""
