"""Spark-first engine for observation-history analytics over listing pages."""

__version__ = "0.1.0"
