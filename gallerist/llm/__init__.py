"""Operators of large-scale training-data pipelines, each on one DataFrame of documents."""
