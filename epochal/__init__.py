"""A Spark-native engine for epoch-ordered, append-only relations.

The package holds a lazy relational pipeline over DataFrames, a checked SQL
surface, exact money arithmetic, a double-entry ledger with as-of and
valid-time reads, incrementally maintained views and a weighted-set algebra.
"""

__version__ = "0.1.0"
