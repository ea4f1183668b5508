"""Operators for large-scale training-data pipelines: tables of documents in, tables out."""
