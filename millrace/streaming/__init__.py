"""Streaming of import pipelines."""
