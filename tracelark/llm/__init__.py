"""Operators for training text. Optional: nothing outside this subpackage imports it."""
