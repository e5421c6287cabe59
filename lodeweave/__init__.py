"""lodeweave: a PySpark-native engine for web-captured product data.

Operators take DataFrames and column names and return DataFrames; queries live
in :mod:`lodeweave.plans`.
"""
