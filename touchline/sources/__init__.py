"""Readers, feed parsers, writers and merges."""
