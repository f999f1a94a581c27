"""Noveltide functions."""
