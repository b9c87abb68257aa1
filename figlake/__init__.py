"""Spark-native extraction of figures and captions from corpora of documents."""
