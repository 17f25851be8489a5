"""Readers, payload parsers, stored-slot tables."""
