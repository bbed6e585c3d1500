"""metricloom: business metrics, profiling and data quality as Spark DataFrames."""

__version__ = "0.1.0"
