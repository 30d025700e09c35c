"""rankmill: retrieval, ranking and text-data processing as PySpark plans."""

__version__ = "0.1.0"
