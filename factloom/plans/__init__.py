"""Composed plans: the ingest pipeline and the engine facade."""
