"""Susceptibility analytics over point and pixel tables, as Spark DataFrame operators."""
