"""Whole query batches: classification, strategies, results, summaries, and graphs derived from tables."""
