"""Spark-native resolution, enrichment and measurement of civic records."""
