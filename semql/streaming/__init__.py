"""Streaming ingestion into vector tables."""
