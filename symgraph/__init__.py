"""Code-intelligence and retrieval engine on PySpark DataFrames."""

__version__ = "0.1.0"
