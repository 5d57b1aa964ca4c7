"""phyllary: a PySpark-native engine for natural-history specimen data."""
