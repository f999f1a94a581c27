"""Noveltide operators."""
