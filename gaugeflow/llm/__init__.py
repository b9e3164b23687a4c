"""Operators for training-data pipelines over text, vectors, pages and conversations."""
