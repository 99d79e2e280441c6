"""Retrieval-corpus analytics on Spark."""
