"""Operators for preparing text corpora for model training, and the pipeline over them."""
