"""Operators over documents: search, chunks, catalog, retention."""
