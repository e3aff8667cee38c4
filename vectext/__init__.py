"""vectext: build and check text-plus-vector datasets with PySpark."""

__version__ = "0.1.0"
