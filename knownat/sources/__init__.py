"""Readers of landed files and writers of published tables."""
