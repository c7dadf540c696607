"""Spark-native geospatial raster and maritime analytics."""
