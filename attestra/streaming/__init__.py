"""Structured Streaming forms of the append-only and windowed operators."""
