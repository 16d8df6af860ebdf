"""Curation and retrieval on streams of sessions."""
