"""Spark jobs that turn page text into a searchable passage corpus."""
