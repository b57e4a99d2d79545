"""Batch operators, each DataFrame in, DataFrame out."""
