"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; it depends on Spark,
numpy, pandas and the public tokenizer files only.
"""
