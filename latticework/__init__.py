"""Spark-native knowledge-graph analytics: entity resolution, provenance graphs, scoped hybrid search."""
