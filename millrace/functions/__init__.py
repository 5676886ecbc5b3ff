"""Functions of import pipelines."""
