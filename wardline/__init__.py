"""Wardline: data-access governance decisions as Spark DataFrame transformations."""
