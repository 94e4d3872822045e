"""A PySpark-native engine for reasoning-benchmark data."""
