"""Spark-native analytics over mail, findings and text corpora."""
