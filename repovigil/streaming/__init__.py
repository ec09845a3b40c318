"""Structured Streaming forms of the job event operators."""
