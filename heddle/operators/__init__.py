"""Heddle operators."""
