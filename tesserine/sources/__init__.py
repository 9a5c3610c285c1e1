"""Readers of files and recorded connectors."""
