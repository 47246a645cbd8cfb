"""logloom: log analytics and training-data preparation on PySpark DataFrames."""

__version__ = "0.2.0"
