"""Operators for preparing text corpora and label sets for model training."""
