"""lakedoc: JSON-document analytics expressed as Spark DataFrame, SQL and streaming plans."""

__version__ = "0.1.0"
