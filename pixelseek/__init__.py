"""Similarity search and image-signature analytics as Spark DataFrame operators."""
