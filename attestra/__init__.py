"""Extraction provenance and accuracy engine on PySpark."""
