"""Continuous ingestion of books."""
