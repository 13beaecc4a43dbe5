"""Spark-native diagnostic analytics: extraction, classification, history, diffs, retrieval and ingest."""
