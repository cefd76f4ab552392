"""Readers of annotation formats and dataset tables, and writers."""
