"""A Spark-native engine for sharded tables."""
