"""Readers and writers of stored tables."""
