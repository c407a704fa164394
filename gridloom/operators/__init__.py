"""Operators over DataFrames: packed fields."""
