"""Structured Streaming forms of the queue and window operators."""
