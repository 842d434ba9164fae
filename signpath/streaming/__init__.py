"""Query batches that arrive as a stream."""
