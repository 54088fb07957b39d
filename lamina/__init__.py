"""Spark-native analytics over hierarchical 2-D layout data."""
