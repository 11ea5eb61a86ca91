"""tracemesh: find identifiers in event logs and link them, as Spark jobs."""

__version__ = "0.1.0"
