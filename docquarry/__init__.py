"""Spark-native operators for extracted financial documents."""
