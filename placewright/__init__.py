"""Spark-native geoparsing, gazetteer analytics and corpus operators."""
