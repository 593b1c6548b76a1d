"""Bit-vector and packed-integer analytics on Spark DataFrames."""
