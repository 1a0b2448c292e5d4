"""Spark jobs for streams of financial transactions."""
