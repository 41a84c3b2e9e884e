"""Metering analytics for Spark: usage facts, cubes, trees, reconciliation and quota queries as DataFrames."""
