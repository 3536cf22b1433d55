"""Spark-native spatial and tabular analytics: DataFrames in, DataFrames out."""
