"""Readers and writers: tracking tables, providers' formats, and the match derived from the given tables."""
