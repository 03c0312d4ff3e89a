"""Retrieval, scoring and advisory analytics over large collections of label documents, on Spark."""
