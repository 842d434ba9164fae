"""Readers of edge lists and query files, writers of results and summaries."""
