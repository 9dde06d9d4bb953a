"""Sidecar metadata documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.starters import read_sidecars


def sidecar_documents(metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document per row of ``metadata``, made of all columns but the keys."""
    fields = [c for c in metadata.columns if c not in keys]
    return metadata.select(*keys, F.to_json(F.struct(*fields)).alias("document"))


def write_sidecars(metadata: DataFrame, keys: Sequence[str], path: str) -> None:
    """One JSON line per document, with its keys beside it so that a reader can find it again."""
    sidecar_documents(metadata, keys).write.mode("overwrite").json(path)


def load_sidecars(df: DataFrame, default_platform: str = "") -> DataFrame:
    """Landed ``bucket, key, content`` documents as normalised metadata."""
    return read_sidecars(df, default_platform)
