"""Spark-native analytics for corpora of peer-review discussions."""
