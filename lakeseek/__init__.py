"""Semantic table search and its analytics on Spark."""
