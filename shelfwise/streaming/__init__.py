"""Structured Streaming variants of the clickstream operators."""
