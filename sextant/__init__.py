"""Sextant: retrieval analytics over text, code and vectors, expressed as Spark plans."""

__version__ = "0.1.0"
