"""Spark jobs for localisation work on page images: regions, text, translations."""
