"""Readers and writers: snapshot documents, feeds, record files, caches, and atomic table replacement."""
