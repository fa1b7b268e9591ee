"""Hybrid retrieval and rank fusion over DataFrames."""
