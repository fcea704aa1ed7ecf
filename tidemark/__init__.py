"""Tidemark: ingest, transform, validate and apply changing data with Spark."""
