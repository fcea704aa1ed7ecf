"""Declarative pipelines and the query catalogue."""
