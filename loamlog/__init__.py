"""Partitioned, append-only message logs as Spark DataFrames."""
