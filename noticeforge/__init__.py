"""Spark-native analytics over notice boards: crawl state, text, graph and retrieval operators."""
