"""Plans of import pipelines."""
