"""A document retrieval and vector search engine on Spark DataFrames."""

__version__ = "0.1.0"
