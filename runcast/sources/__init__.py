"""Readers, parsers, writers and row generators."""
