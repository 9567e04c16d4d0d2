"""Structured Streaming form of the look-back refresh."""
