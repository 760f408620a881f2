"""Spark-native retrieval, graph, code and corpus analytics over project knowledge."""
