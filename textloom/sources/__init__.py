"""Readers that land files and payloads as tables."""
