"""Registered queries, by kind. Importing a module registers its queries."""

from . import aggregates, joins, metrics, models, rows, scans, structure

__all__ = ["aggregates", "joins", "metrics", "models", "rows", "scans", "structure"]
