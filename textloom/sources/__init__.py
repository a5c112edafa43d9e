"""Readers: file trees, archives, written corpora."""
