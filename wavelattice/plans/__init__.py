"""Registered queries over the bound tables."""
