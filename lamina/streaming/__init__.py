"""Structured Streaming jobs of the layout engine."""
