"""Spark-native document catalogue, synchronisation and permitted retrieval."""
