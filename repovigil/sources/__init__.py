"""Readers, admission checks and sinks."""
