"""Listing operators, DataFrame to DataFrame."""
