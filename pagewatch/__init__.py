"""Spark-native analytics for tracking what public campaign pages say over time."""
