"""Readers: dumps, catalogues, artifacts."""
