"""Corpus operators for training data: scans, formatting, deduplication, scoring and mixing."""
