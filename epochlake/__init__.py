"""Spark operators for epoch-structured signals, the experiments on them, and text corpora."""
