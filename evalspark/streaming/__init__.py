"""Structured Streaming jobs over the experiment log and arriving artifacts."""
