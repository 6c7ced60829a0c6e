"""Scalar Column expressions."""
