"""Continuously kept results."""
