"""Lamina: a Spark-native engine for layered-sensor rasters and their containers."""
