"""Spark-native analytics over a bi-temporal memory store."""
