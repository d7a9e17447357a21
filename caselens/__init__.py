"""Spark-native investigation of large delimited evidence files and tables."""
