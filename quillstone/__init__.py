"""Spark-native corporate evidence analytics: registries, filings and observations as DataFrames."""
