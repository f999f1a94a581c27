"""Noveltide plans."""
