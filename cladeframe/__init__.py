"""Lineage analytics on PySpark: point sets over time, links between them, and their scores."""
