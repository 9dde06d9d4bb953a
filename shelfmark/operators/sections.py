"""Markdown files to sections and entries, without a shuffle and without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import (
    IN_LINE,
    WS_INLINE,
    excerpt,
    js_trim,
    keywords,
    path_hash,
    slugify,
    with_fallback,
)

#: One heading line, preceded by a line feed; a carriage return before the line end makes it plain text.
_HEADING_LINE = rf"\n#{{1,6}}[{WS_INLINE}]+[{IN_LINE}]+(?=\n|\z)"

ENTRY_COLUMNS = [
    "owner",
    "repository",
    "src_ord",
    "file_ord",
    "sec_ord",
    "content_path",
    "hash",
    "title",
    "excerpt",
    "content",
    "type",
    "sub_type",
    "keywords",
]


def markdown_sections(files: DataFrame) -> DataFrame:
    """One row per heading: ``sec_ord, level, heading, body`` besides the file columns.

    Headings and the texts between them come from two regular-expression passes over the whole
    text, so a file stays in its row and nothing is shuffled.
    """
    text = F.concat(F.lit("\n"), F.col("content"))
    headings = F.regexp_extract_all(text, F.lit(_HEADING_LINE), 0)
    pieces = F.split(text, _HEADING_LINE)
    # The first piece precedes the first heading; an empty line stands for its heading.
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), headings).alias("line"), pieces.alias("body"))
    keep = [c for c in files.columns if c != "content"]
    return (
        # the outer form, as Spark would test the plain one's array for emptiness by making it once more
        files.select(*keep, F.posexplode_outer(zipped).alias("pos", "sec"))
        .where(F.col("pos") > 0)
        .select(
            *keep,
            (F.col("pos") - 1).alias("sec_ord"),
            F.length(F.regexp_extract("sec.line", r"\A\n(#{1,6})", 1)).alias("level"),
            js_trim(F.regexp_replace("sec.line", r"\A\n#{1,6}", "")).alias("heading"),
            js_trim(F.col("sec.body")).alias("body"),
        )
    )


def markdown_entries(files: DataFrame) -> DataFrame:
    """One entry per section whose heading has a non-empty slug."""
    slug = slugify(F.col("heading"))
    words = keywords(F.concat_ws("\n", "heading", "body"))
    spaced = js_trim(F.regexp_replace("slug", "-", " "))
    fallback = F.when(spaced != "", spaced).otherwise(F.lower("heading"))
    path = F.concat_ws("/", "owner", "repo", "path", "slug")
    return (
        markdown_sections(files)
        .withColumn("slug", slug)
        .where(F.col("slug") != "")
        # Used twice below, so kept as columns of their own.
        .withColumns({"content_path": path, "words": words})
        .select(
            "owner",
            F.col("repo").alias("repository"),
            "src_ord",
            "file_ord",
            "sec_ord",
            "content_path",
            path_hash(F.col("content_path")).alias("hash"),
            F.col("heading").alias("title"),
            excerpt(F.col("body")).alias("excerpt"),
            F.col("body").alias("content"),
            F.lit("documentation").alias("type"),
            F.lit("guide").alias("sub_type"),
            with_fallback(F.col("words"), fallback).alias("keywords"),
        )
    )
