"""Spark streaming of the engine."""
