"""Time-respecting feature tables and classifiers as Spark jobs."""

__version__ = "0.1.0"
