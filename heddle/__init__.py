"""Heddle: code-ownership analytics as Spark DataFrame queries."""
