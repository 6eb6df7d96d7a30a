"""corvane: set-at-a-time code search, retrieval evaluation and index building on Spark."""

__version__ = "0.1.0"
