"""Spark-first engine for positioned-token indexes over text collections."""
