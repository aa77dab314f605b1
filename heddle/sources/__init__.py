"""Heddle sources."""
