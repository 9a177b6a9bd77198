"""A Spark-native analytics engine for positional tracking and event tables."""
