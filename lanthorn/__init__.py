"""A Spark-native engine for scanning text for sensitive content."""
