"""Spark-native analytics over memory-augmented language-model records."""
