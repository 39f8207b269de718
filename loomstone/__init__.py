"""loomstone: a PySpark-native analytics engine for facts extracted from source code.

Symbols, typed relationships, use sites and source text are DataFrames; every operator
is a function from DataFrames to a DataFrame.
"""
