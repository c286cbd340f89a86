"""tidemark: point-in-time market research on PySpark DataFrames."""

__version__ = "0.1.0"
