"""Bars from tables."""
