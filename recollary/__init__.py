"""recollary: memory retrieval, consolidation and session analytics on Spark DataFrames."""

__version__ = "0.1.0"
