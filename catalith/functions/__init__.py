"""Scalar functions on columns; those without a built-in form run as Arrow functions."""
