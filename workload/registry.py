"""Registration of queries and assembly of their SQL from shared CTEs."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}

MODULES = [
    "adapters",
    "corpus",
    "code_files",
    "functions",
    "catalog",
    "log_reports",
    "rate_windows",
    "names",
    "site",
    "repo_details",
    "index_store",
]


class Tables:
    """The supplied parquet tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use any registered CTE by name."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def _references(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [name for name in _CTES if name in words]


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it uses, directly or through others, in definition order."""
    needed: set[str] = set()
    frontier = [sql]
    while frontier:
        for name in _references(frontier.pop()):
            if name not in needed:
                needed.add(name)
                frontier.append(_CTES[name])
    if not needed:
        return sql.strip()
    parts = [f"{name} AS MATERIALIZED (\n{_CTES[name]}\n)" for name in _CTES if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def load_all() -> None:
    for module in MODULES:
        try:
            importlib.import_module(f"workload.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"workload.{module}":
                raise
