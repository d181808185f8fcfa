"""Tidemark: governed analytics and corpus processing on Spark."""
