"""Spark-native analytics over timed, multi-speaker conversations."""
