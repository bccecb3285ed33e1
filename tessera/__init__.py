"""Spark-native evidence and state analytics."""
