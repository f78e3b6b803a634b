"""Readers, writers and the recording ingest."""
