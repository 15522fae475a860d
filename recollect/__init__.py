"""A PySpark-native engine for long-term memory and retrieval analytics."""
