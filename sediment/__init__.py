"""Sediment: Spark-native preparation, indexing and evaluation of evidence corpora."""
