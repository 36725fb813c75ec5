"""Spark-native work-order classification and training-data processing."""
