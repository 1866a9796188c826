"""Planted data for tests and measurements."""
