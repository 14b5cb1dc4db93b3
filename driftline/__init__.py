"""Spark-native analytics for irregular, gap-ridden time series."""
