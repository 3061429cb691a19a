"""Halocline: ocean and atmosphere analytics, and corpus work, as Spark jobs."""
