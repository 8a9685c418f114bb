"""Continuous import of a folder."""
