"""Spark-native operators for public-record analytics."""
