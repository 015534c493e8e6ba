"""Spark-native analytics for 3D-capture and imaging tables."""
