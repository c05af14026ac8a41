"""Continuous ingest: an extension beyond batch quarters."""
