"""Operators of a training-data pipeline: tokens, filters, packing, duplicates, privacy, search."""
