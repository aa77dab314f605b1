"""Heddle functions."""
