"""Spark-native engine for fiscal documents, with a corpus-preparation subpackage."""
