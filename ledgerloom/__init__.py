"""Ledgerloom: entity-by-period panel analytics on Spark DataFrames."""
