"""Evidence analytics on Spark: text, retrieval, rule, figure and statistics operators on DataFrames."""

__version__ = "0.1.0"
