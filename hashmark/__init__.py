"""Spread analytics on Spark: plain ``DataFrame -> DataFrame`` operators."""

__version__ = "0.1.0"
