"""Hop-constrained signed reachability on Spark."""
