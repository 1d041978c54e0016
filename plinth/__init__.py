"""Plinth: Spark-native analytics for nested vector plans."""
