"""Continuous import."""
