"""Spark-native analytics over tracking and event tables."""
