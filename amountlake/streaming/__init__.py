"""Parsing of streams."""
