"""Corpus operators for training data: mixing, sharding, filtering, search and deduplication."""
