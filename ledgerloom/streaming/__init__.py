"""Structured Streaming jobs; they give the rows the batch operators give."""
