"""Spark jobs for building and quality-controlling datasets of verified decisions."""
