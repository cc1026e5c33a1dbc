"""Feature preparation, scoring and drift monitoring as Spark jobs."""

__version__ = "0.1.0"
