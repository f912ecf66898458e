"""rankloom: people-and-organisation analytics on Spark DataFrames."""

__version__ = "0.1.0"
