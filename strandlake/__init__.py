"""Spark-native similarity search, overlap graph and consensus analytics."""
