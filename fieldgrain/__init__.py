"""Spark-first quantification of objects in images, at dataset scale."""
