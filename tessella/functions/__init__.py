"""Scalar functions as Spark columns, with Python twins where the driver needs one value."""
