"""Spark-native analytics and retrieval over extracted documents."""
