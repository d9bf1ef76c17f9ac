"""Corporate-entity and ownership analytics as Spark jobs."""

__version__ = "0.1.0"
