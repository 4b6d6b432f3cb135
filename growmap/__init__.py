"""growmap: growing self-organising maps and their analytics on Spark DataFrames."""

__version__ = "0.1.0"
