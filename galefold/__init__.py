"""Spark-native analytics for Doppler weather-radar volumes."""
