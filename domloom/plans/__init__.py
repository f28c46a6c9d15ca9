"""Selectors and policies compiled to Spark plans and expressions."""
