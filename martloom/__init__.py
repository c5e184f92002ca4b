"""martloom: warehouse-style modelling and analysis over text tables, built on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources"]
