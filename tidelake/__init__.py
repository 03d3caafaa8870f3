"""Spark jobs for the data work behind a click-through-rate recommender."""
