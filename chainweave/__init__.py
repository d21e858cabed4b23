"""Immune-repertoire analytics expressed as Spark DataFrame programs."""
