"""Lectern: passage retrieval, answer evaluation and text preparation as Spark plans."""

__version__ = "0.1.0"
