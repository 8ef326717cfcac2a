"""Data preparation and business analytics as lazy PySpark DataFrame operators."""
