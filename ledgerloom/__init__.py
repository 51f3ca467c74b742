"""A Spark-native engine for reconciling semi-structured line and table data."""
