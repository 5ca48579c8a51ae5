"""Spark-native sports-tracking analytics."""
