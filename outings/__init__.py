"""Spark analytics for places and events: ingest, enrich, upsert, rank, monitor."""
