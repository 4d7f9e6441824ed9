"""Spark-native software-estate analytics."""
