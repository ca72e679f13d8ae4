"""Readers and writers for raw scan files and stage tables."""
