"""Readers of landed files and writers of results, all as Spark jobs."""
