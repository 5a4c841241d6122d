"""Document facts at scale: a PySpark-native engine."""
