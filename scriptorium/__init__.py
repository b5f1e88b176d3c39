"""Spark-native document analytics: parsing, chunking, tagging, retrieval, merging and audit."""
