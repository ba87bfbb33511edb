"""lodeline: line-oriented log and JSON-lines analytics on Spark DataFrames."""

__version__ = "0.1.0"
