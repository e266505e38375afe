"""Web-evidence analytics as Spark jobs: findings, listings, reports, graph, pages, statistics."""

__version__ = "0.1.0"
