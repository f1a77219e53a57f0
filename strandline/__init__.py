"""strandline: sequence analytics and corpus preparation as lazy Spark DataFrames."""

__version__ = "0.1.0"
