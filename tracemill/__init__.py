"""Spark-native peak analytics, dataset audits and evaluation metrics."""
