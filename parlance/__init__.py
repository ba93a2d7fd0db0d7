"""Spark-native engine for dialogue data, preference analytics and corpus preparation."""
