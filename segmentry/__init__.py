"""Ordered-interval analytics on Spark: segments, as-of alignment, stitching and weighted metrics."""
