"""tideline: a PySpark-native engine for event-time tables."""
