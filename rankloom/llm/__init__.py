"""Operators on texts and records for training data. Nothing outside this package imports it."""
