"""A Spark-native engine for examining how news coverage unfolds across sources and languages."""
