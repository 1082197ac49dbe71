"""Gleanery: retrieval over scattered knowledge data, written as Spark jobs."""
