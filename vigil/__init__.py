"""Vigil: Spark-native tracking of web content that may disappear."""
