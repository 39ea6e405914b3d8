"""Spark-native analytics over document collections: functions."""
