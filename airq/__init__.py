"""PySpark-native air-quality analytics."""
