"""Filtered vector search and document metadata analytics on Spark."""
