"""Spark-native engine for document-structure analytics."""
