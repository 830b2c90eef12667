"""Scalar functions, each from Column to Column, so that Catalyst sees them as built-in expressions."""
