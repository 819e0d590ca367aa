"""Structured Streaming forms of the rollups, bars and alerts."""
