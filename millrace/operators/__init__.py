"""Operators of import pipelines."""
