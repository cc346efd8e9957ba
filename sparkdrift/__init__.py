"""Data quality, time-series features and distribution drift on Spark DataFrames."""

__version__ = "0.1.0"
