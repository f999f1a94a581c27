"""Noveltide sources."""
