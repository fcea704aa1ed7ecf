"""Column-level pieces: pipeline steps, the small expression language, types."""
