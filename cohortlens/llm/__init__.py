"""Operators for large-scale training-data pipelines (text, pages, codes)."""
