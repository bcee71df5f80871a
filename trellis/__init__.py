"""Trellis: a PySpark-native engine for building, merging and analysing knowledge graphs."""

__version__ = "0.1.0"
