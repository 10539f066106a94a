"""A PySpark-native bi-temporal memory engine."""
