"""Monthly buy-point analytics expressed as Spark DataFrame jobs keyed by instrument."""

__version__ = "0.1.0"
