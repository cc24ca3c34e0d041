"""pagelog: versioned page logs as Spark DataFrames."""

__version__ = "0.1.0"
