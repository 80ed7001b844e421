"""Spark-native online evaluation of many competing document rankers."""
