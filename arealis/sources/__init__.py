"""Readers, writers and the shaping of payloads."""
