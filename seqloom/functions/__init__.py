"""Scalar functions as columns, and edit distances."""
