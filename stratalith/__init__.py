"""Spark-native operators for dating, ordering and comparing bodies of text."""
