"""Operators over tables: DataFrame in, DataFrame out."""
