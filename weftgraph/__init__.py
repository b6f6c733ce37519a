"""Property-graph analytics for source code, built on Spark DataFrames."""

__version__ = "0.1.0"
SCHEMA_VERSION = "2.0.0"
