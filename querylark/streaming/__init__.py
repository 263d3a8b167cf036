"""Ingestion as micro-batches."""
