"""Operators: tagging, decoding, parsing, metrics, corpus work, synthetic data."""
