"""Long texts in pieces of bounded size, cut by native expressions inside the text's row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK_BYTES = 40_000


#: A range is one number: its start times this, plus its end.
_UNIT = 1 << 31


def _held(data: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a text's bytes, which it gets as a lambda's variable.

    Inside a lambda, a column of bytes is copied whole each time it is named; a variable is not.
    """
    return F.get(F.transform(F.array(data), use), F.lit(0))


def _inside_character(data: Column, at: Column) -> Column:
    """Whether the byte at a place goes on with a character of UTF-8."""
    return F.hex(F.substring(data, at + 1, 1)).between("80", "BF")


def chunk_spans(data: Column, limit: int) -> Column:
    """Ranges of the chunks of a text's UTF-8 bytes, one number each.

    From its start a chunk goes to the last line end within the limit, and the next one begins behind that line end; if there is none,
    it is cut after the last character within the limit.  A step looks at one chunk's bytes.  Two chunks that follow each other hold
    about ``limit`` bytes or more, which bounds the steps.
    """
    total = F.length(data)
    steps = F.sequence(F.lit(1), F.ceil(total * 2 / F.lit(limit - 3)).cast("int") + 2)

    def state(so_far: Column, end: Column, following: Column) -> Column:
        span = so_far["next"].cast("bigint") * F.lit(_UNIT) + end
        return F.struct(F.concat(so_far["spans"], F.array(span)).alias("spans"), following.cast("int").alias("next"))

    def step(so_far: Column, _: Column) -> Column:
        start = so_far["next"]
        # one byte a character, so that places are places of bytes
        ahead = F.decode(F.substring(data, start + 1, F.lit(limit + 1)), "ISO-8859-1")
        line_end = start + F.lit(limit) - F.length(F.substring_index(ahead, "\n", -1))
        last = start + F.lit(limit)
        cut = (
            F.when(~_inside_character(data, last), last)
            .when(~_inside_character(data, last - 1), last - 1)
            .when(~_inside_character(data, last - 2), last - 2)
            .otherwise(last - 3)
        )
        return (
            F.when(start > total, so_far)
            .when(total - start <= limit, state(so_far, total, total + 1))
            .when(line_end >= start, state(so_far, line_end, line_end + 1))
            .otherwise(state(so_far, cut, cut))
        )

    none = F.array().cast("array<bigint>")
    return F.aggregate(steps, F.struct(none.alias("spans"), F.lit(0).alias("next")), step, lambda end: end["spans"])


def chunk_content(
    documents: DataFrame, key: str, text: str, max_bytes: int = DEFAULT_CHUNK_BYTES
) -> DataFrame:
    """``key, chunk_index, total_chunks, chunk``; a null text is empty and one chunk.  No text leaves its row before it is cut."""
    if max_bytes < 4:
        raise ValueError("max_bytes must hold at least one character (4 bytes)")
    whole = F.coalesce(F.col(text), F.lit(""))
    data = documents.select(F.col(key), F.encode(whole, "UTF-8").alias("data"))
    spans = F.when(F.length("data") <= max_bytes, F.array(F.length("data").cast("bigint"))).otherwise(
        _held(F.col("data"), lambda held: chunk_spans(held, max_bytes))
    )
    cut = data.select(key, "data", spans.alias("spans"))

    def piece(held: Column, span: Column) -> Column:
        start = F.floor(span / F.lit(_UNIT)).cast("int")
        return F.decode(F.substring(held, start + 1, F.pmod(span, F.lit(_UNIT)).cast("int") - start), "UTF-8")

    pieces = _held(F.col("data"), lambda held: F.transform("spans", lambda span: piece(held, span)))
    chunks = cut.select(key, pieces.alias("chunks"))
    return chunks.select(
        key, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk")
    ).select(key, "chunk_index", "total_chunks", "chunk")


def get_chunks(wanted: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``want_id, key, chunk_index`` to the chunk; an index out of range gives an error with the valid range."""
    totals = chunks.where("chunk_index = 0").select(key, "total_chunks")
    found = wanted.join(totals, key, "left").join(
        chunks.select(key, "chunk_index", "chunk"), [key, "chunk_index"], "left"
    )
    last = (F.col("total_chunks") - 1).cast("string")
    index = F.col("chunk_index").cast("string")
    out_of_range = F.concat(F.lit("chunkIndex "), index, F.lit(" is out of range. Valid range: 0-"), last)
    return found.select(
        "want_id",
        key,
        "chunk_index",
        "total_chunks",
        "chunk",
        F.when(F.col("total_chunks").isNull(), "TEMPLATE_NOT_FOUND")
        .when(F.col("chunk").isNull(), "INVALID_CHUNK_INDEX")
        .alias("code"),
        F.when(F.col("total_chunks").isNotNull() & F.col("chunk").isNull(), out_of_range).alias("message"),
    )
