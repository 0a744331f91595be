"""Scalar and array functions built from Spark expressions."""
