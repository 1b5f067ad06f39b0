"""A PySpark-native analytics engine for the usage and cost of AI coding tools."""
