"""Corpus, manifest and hint readers; tree and mode writers."""
