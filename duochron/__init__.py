"""Spark engine for paired, ordered measurements of the same entities in two modalities."""
