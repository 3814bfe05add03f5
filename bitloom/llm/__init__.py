"""Operators for preparing large text collections as training data. Nothing outside this package imports it."""
