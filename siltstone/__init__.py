"""Spark-native analytics over document collections: package root."""
