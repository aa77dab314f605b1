"""Heddle plans."""
