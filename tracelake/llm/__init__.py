"""Operators for large training-data pipelines over text, page and label tables."""
