"""Spark-native reading, scoring and annotation of books, pages and text tables."""
