"""Subpackage of trellis; see the README for the map of modules."""
