"""Operators for large-scale training-text pipelines. Nothing else in the library imports them."""
