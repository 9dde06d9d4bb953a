"""Details and summaries of template files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import byte_size, exceeds
from shelfmark.functions.versions import human_version
from shelfmark.operators.chunks import DEFAULT_CHUNK_BYTES, chunk_content
from shelfmark.operators.yaml_documents import load_template, scalar_text

#: Larger templates are summarised.
SUMMARY_BYTES = 50_000
_PARSED = (
    "description string, parameters map<string, map<string, string>>, outputs map<string, map<string, string>>, "
    "resources map<string, string>, metadata string"
)


def _text(value) -> str:
    """A value as text; mappings, such as references, as JSON."""
    return json.dumps(value, default=str, separators=(",", ":")) if isinstance(value, dict) else scalar_text(value)


def _texts(value) -> dict[str, dict[str, str]]:
    """Nested mapping as a map of maps of texts; other values have no fields."""
    items = value.items() if isinstance(value, dict) else ()
    return {str(k): {str(f): _text(t) for f, t in v.items()} if isinstance(v, dict) else {} for k, v in items}


def _parse(content: str) -> tuple:
    template = load_template(content or "", keep_function_names=True)
    if not isinstance(template, dict):
        return "", {}, {}, {}, None
    resources = template.get("Resources")
    types = {
        str(k): str(v.get("Type") or "Unknown") if isinstance(v, dict) else "Unknown"
        for k, v in (resources.items() if isinstance(resources, dict) else ())
    }
    metadata = template.get("Metadata")
    return (
        scalar_text(template["Description"]) if template.get("Description") else "",
        _texts(template.get("Parameters")),
        _texts(template.get("Outputs")),
        types,
        json.dumps(metadata, default=str) if metadata else None,
    )


def template_details(files: DataFrame, key: str = "key") -> DataFrame:
    """``key, content`` to version, description, parameters, outputs, resources and metadata.

    The version comes from the header comment; everything is empty when the text cannot be read.
    """
    names = [c.split()[0] for c in ("description", "parameters", "outputs", "resources", "metadata")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([_parse(c) for c in batch["content"]], columns=names, index=batch.index)
            yield pd.concat([batch[[key, "version"]], rows], axis=1)

    typed = files.select(key, human_version(F.col("content")).alias("version"), "content")
    key_type = dict(typed.dtypes)[key]
    return typed.mapInPandas(parse, f"{key} {key_type}, version string, {_PARSED}")


def template_summaries(
    files: DataFrame, key: str = "key", threshold: int = SUMMARY_BYTES, chunk_bytes: int = DEFAULT_CHUNK_BYTES
) -> DataFrame:
    """Details of every template without its text, its size, whether that exceeds the threshold, and its number of chunks."""
    sizes = files.select(key, byte_size(F.col("content")).alias("content_bytes"), exceeds(F.col("content"), threshold).alias("content_truncated"))
    totals = chunk_content(files, key, "content", chunk_bytes).where("chunk_index = 0").select(key, "total_chunks")
    resources = F.transform(
        F.map_entries("resources"), lambda e: F.struct(e["key"].alias("logical_id"), e["value"].alias("type"))
    )
    return (
        template_details(files, key)
        .join(totals, key)
        .join(sizes, key)
        .withColumn("resources", resources)
    )
