"""Alignment of sources and intervals."""
