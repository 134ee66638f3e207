"""Volumetric analytics as lazy PySpark DataFrame transformations."""
