"""Morphological analysis of text columns on Spark."""

__version__ = "0.2.0"
