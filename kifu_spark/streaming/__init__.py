"""Structured Streaming forms of the batch operators; each has a batch twin that defines its result."""
