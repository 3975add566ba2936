"""The registered queries."""

from ..registry import QUERIES, SQL
from . import cluster, measures, object_store, repair, scans, store_cycles  # noqa: F401

__all__ = ["QUERIES", "SQL"]
