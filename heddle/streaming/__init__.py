"""Heddle streaming."""
