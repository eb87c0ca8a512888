"""Structured Streaming forms of the trip and cell operators."""
