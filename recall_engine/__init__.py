"""Spark-native analytics over append-only knowledge logs."""
