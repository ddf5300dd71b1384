"""Exact analytics over compact binary codes, and training-data operators, on PySpark."""
