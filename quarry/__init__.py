"""Spark-native engine for tables and documents: lazy functions from DataFrame to DataFrame."""
