"""Earshot: a PySpark-native analytics engine for long recordings and their time-segmented annotations."""

__version__ = "0.1.0"
