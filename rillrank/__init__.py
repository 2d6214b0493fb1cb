"""A PySpark-native engine for recommendation click-logs."""
