"""Leafmill: web-response extraction and collection jobs as PySpark DataFrames."""

__version__ = "0.1.0"
