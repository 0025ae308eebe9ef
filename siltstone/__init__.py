"""siltstone: file-system metadata and journal analytics on Spark DataFrames."""

__version__ = "0.1.0"
