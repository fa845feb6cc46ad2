"""A PySpark-native engine for rule-based analysis of token streams."""
