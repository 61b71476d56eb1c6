"""Spark-native trace and latency analytics."""
