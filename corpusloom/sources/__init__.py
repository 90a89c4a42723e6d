"""Readers and writers: text corpora, the chunk store, the evaluation archive."""
