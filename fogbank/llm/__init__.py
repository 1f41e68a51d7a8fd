"""Operators for building training corpora. Nothing outside this package imports it."""
