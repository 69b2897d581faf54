"""Seasonal price analytics as Spark DataFrame transformations."""
