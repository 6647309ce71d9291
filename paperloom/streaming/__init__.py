"""Recurring runs as Structured Streaming queries."""
