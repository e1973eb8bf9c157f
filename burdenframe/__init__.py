"""Rare-variant burden analytics as lazy Spark DataFrame transformations."""
