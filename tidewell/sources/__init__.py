"""Readers of raw feeds and writers of results."""
