"""Marginalia: a PySpark-native engine for knowledge-base retrieval and text-corpus preparation.

Every operator is a function from DataFrames to a DataFrame; nothing is collected
unless a docstring says so and names the bound.
"""

__version__ = "0.1.0"
