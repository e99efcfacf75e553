"""Operators for training-data pipelines over the text, page and embedding tables."""
