"""Spark-first nearest-neighbour search: vectors, codes and posting lists as DataFrames."""
