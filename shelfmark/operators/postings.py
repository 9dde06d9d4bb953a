"""Entries to an inverted index with precomputed scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import inside_tokens, lower_tokens, type_weight, weighted_score
from shelfmark.operators.ranking import first_wins
from shelfmark.session import stored

#: Source, repository, file and section order; the first entry of a path is the one that stays.
ENTRY_ORDER = ["src_ord", "repository", "file_ord", "sec_ord"]


def unique_entries(entries: DataFrame) -> DataFrame:
    """First entry per content path, of which the hash is the whole SHA-256."""
    return first_wins(entries, ["hash"], ENTRY_ORDER)


def first_rows(table: DataFrame) -> DataFrame:
    """``name, part, bits``: a bit for each row of a stored table of entries that :func:`unique_entries` would keep.

    Only hashes and places in files move.  ``table`` must be as read from its files.
    """
    # from 1, as parts of a bitmap end there
    row = (F.col("_metadata.row_index") + 1).alias("row")
    places = table.select("hash", *ENTRY_ORDER, F.col("_metadata.file_name").alias("name"), row)
    first = first_wins(places, ["hash"], ENTRY_ORDER).select(
        "name", F.bitmap_bucket_number("row").alias("part"), F.bitmap_bit_position("row").alias("bit")
    )
    return first.groupBy("name", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def rows_marked(table: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of a stored table whose bits are set in ``marks``, as :func:`first_rows` gives them.

    No row moves: the marks are broadcast, which are one bit for each row of the table.
    """
    row = F.col("_metadata.row_index") + 1
    placed = table.select(
        "*", F.col("_metadata.file_name").alias("name"), F.bitmap_bucket_number(row).alias("part"), F.bitmap_bit_position(row).alias("bit")
    )
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, CAST(bit % 8 AS INT)) & 1") == 1
    met = placed.join(F.broadcast(marks), ["name", "part"]).withColumn("byte", byte)
    return met.where(is_set).select(*table.columns)


def stored_unique_entries(entries: DataFrame) -> DataFrame:
    """:func:`unique_entries`, with all entries stored: the texts are written once and do not move."""
    table = stored(entries, "entries")
    return rows_marked(table, stored(first_rows(table), "first_rows"))


def postings(entries: DataFrame, scored_on: str = "content") -> DataFrame:
    """``keyword, hash, relevance_score, type_weight``: one row per entry and distinct keyword.

    A keyword scores where it occurs in the whole body; ``scored_on="excerpt"`` looks at the excerpt only.  An entry's words are
    sorted by where they occur in its own row, in time that follows its length, and only words and scores leave it.
    """
    # A posting's keyword is one of its entry's own keywords, so that part always counts; keywords, title and body
    # are brought to lower case once per entry.
    texts = entries.select(
        "hash",
        type_weight(F.col("type")).alias("type_weight"),
        F.array_distinct(F.transform("keywords", F.lower)).alias("words"),
        F.coalesce(F.lower("title"), F.lit("")).alias("title"),
        F.coalesce(F.lower(scored_on), F.lit("")).alias("body"),
    )
    # Each step's columns are used by the next more than once, so they stay columns: nothing is split or compared twice.
    tokens = texts.select("*", lower_tokens(F.col("title")).alias("title_tokens"), lower_tokens(F.col("body")).alias("body_tokens"))
    found = tokens.select(
        "*",
        F.array_intersect("words", "title_tokens").alias("title_words"),
        F.array_intersect("words", "body_tokens").alias("body_words"),
    )
    # Most words are in the body and few in the title, so what remains is told from those few and from the few that are nowhere.
    apart = found.select(
        "*", F.array_except("words", "title_words").alias("title_rest"), F.array_except("words", "body_words").alias("body_rest")
    )

    def inside(part: str, text: str) -> Column:
        return inside_tokens(F.col(f"{part}_rest"), F.col(text), F.col(f"{part}_tokens"))

    placed = apart.select(
        "hash",
        "type_weight",
        "words",
        F.concat("title_words", inside("title", "title")).alias("titled"),
        F.array_except("body_rest", inside("body", "body")).alias("untold"),
    )
    groups = [
        (F.array_except("titled", "untold"), True, True),
        (F.array_intersect("titled", "untold"), True, False),
        (F.array_except("words", F.concat("titled", "untold")), False, True),
        (F.array_except("untold", "titled"), False, False),
    ]

    def scored(words: Column, in_title: bool, in_body: bool) -> Column:
        score = weighted_score(F.lit(in_title), F.lit(in_body), F.lit(True), F.col("type_weight"))
        return F.transform(words, lambda w: F.struct(w.alias("keyword"), score.alias("relevance_score")))

    rows = placed.select("hash", "type_weight", F.concat(*[scored(*group) for group in groups]).alias("scored"))
    # the outer form, as Spark would test the plain one's array for emptiness by making it once more
    found = rows.select("hash", "type_weight", F.explode_outer("scored").alias("found")).where(F.col("found").isNotNull())
    return found.select("found.keyword", "hash", "found.relevance_score", "type_weight")


def build_stats(entries: DataFrame) -> DataFrame:
    """Entries per repository, counted before duplicates are removed."""
    return entries.groupBy("owner", "repository").agg(F.count(F.lit(1)).alias("entry_count"))


def build_totals(entries: DataFrame) -> DataFrame:
    """Total entries before duplicates are removed, and repositories that gave any."""
    per_repo = build_stats(entries)
    return per_repo.agg(
        F.coalesce(F.sum("entry_count"), F.lit(0)).alias("total_entries"),
        F.count(F.lit(1)).alias("total_repos"),
    )
