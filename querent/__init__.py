"""Spark-native retrieval and document analytics over DataFrames."""
