"""Readers, their contracts, and the adapter for the star-schema tables."""
