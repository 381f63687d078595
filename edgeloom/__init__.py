"""edgeloom: graph analytics, sequence primitives and network embedding on Spark DataFrames."""

__version__ = "0.1.0"
