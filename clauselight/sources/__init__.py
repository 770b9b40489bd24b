"""Readers with fixed schemas, and the adapters from the sample tables."""
