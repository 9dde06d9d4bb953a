"""Queries over the supplied tables, each with the SQL that must give the same rows."""

from workload.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
