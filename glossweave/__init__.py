"""Spark-native analytics over definition graphs: vocabularies whose words are defined by other words."""
