"""A Spark-native engine for keyed JSON documents."""
