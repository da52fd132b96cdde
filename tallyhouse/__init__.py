"""Governed business metrics on Spark: DataFrame plans over a 20-table business model."""
