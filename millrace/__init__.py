"""Millrace: a PySpark-native SQL, key-value and data-preparation engine."""
