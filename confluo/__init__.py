"""Confluo: a Spark-native engine that consolidates people records and prepares large text corpora."""
