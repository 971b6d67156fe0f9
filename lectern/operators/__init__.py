"""Spark operators of the engine."""
