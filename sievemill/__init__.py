"""A PySpark-native engine for document and fact analytics."""
