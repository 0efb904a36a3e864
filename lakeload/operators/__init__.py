"""Operators on data frames and tables."""
