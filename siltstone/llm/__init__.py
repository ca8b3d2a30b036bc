"""Operators for training-data text and identifier sets. Nothing outside this package imports it."""
