"""Coding and curation of short text records against a hierarchical taxonomy, on Spark."""
