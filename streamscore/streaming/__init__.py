"""Structured Streaming jobs that maintain the derived tables."""
