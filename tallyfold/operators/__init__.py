"""Operators on long tables (asset, date, values)."""
