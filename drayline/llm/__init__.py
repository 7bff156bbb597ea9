"""Operators for the preparation of training data. Nothing outside this subpackage imports it."""
