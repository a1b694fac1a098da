"""A Spark-native text search, ranking and retrieval engine."""
