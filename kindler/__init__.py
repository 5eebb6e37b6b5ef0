"""Spark-native geospatial risk analytics."""
