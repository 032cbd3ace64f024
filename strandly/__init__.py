"""Variant call analytics on Spark: call sets, intervals and sequences as DataFrames."""
