"""Readers, payload parsers, keyed writes and the tables derived from the test data."""
