"""Structured Streaming over arriving genome tables."""
