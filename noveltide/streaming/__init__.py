"""Noveltide streaming."""
