"""Operators from DataFrame to DataFrame: dedup, files, chunks, retrieval, clusters."""
