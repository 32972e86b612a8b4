"""Relational and signal operators: DataFrame in, DataFrame out."""
