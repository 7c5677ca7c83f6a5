"""Operators of a pipeline for training data: extraction, search, filters, duplicates, packing, shards."""
