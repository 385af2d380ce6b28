"""Operators for training data: packing, scans, counts, filters, dedup, search."""
