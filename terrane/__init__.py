"""terrane: evidence-backed spatial and temporal analytics on PySpark DataFrames."""

__version__ = "0.1.0"
