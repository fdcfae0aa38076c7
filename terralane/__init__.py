"""Spatio-temporal analytics as PySpark DataFrames and SQL expressions."""
