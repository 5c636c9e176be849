"""Structured Streaming forms of the aggregates that carry over."""
