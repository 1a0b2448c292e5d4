"""Batch tables and record streams."""
