"""Operators (DataFrame -> DataFrame)."""
