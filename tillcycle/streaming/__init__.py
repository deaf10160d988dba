"""Structured Streaming variants of batch jobs."""
