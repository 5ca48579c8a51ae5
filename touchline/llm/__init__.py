"""Operators for preparing training text: scans, media, quality, packing, dedup."""
