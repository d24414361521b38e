"""Spark-native analytics for volumes on spherical grids."""
