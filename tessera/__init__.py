"""Spark-native numerical analytics over DataFrames."""
