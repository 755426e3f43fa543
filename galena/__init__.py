"""Medallion, quality and governed-metric operators as PySpark DataFrame transformations."""
