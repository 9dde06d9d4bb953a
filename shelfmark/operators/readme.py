"""README files: section numbers, title, description, bullets and the stack table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import LINE_ENDS, WS_INLINE, js_trim
from shelfmark.operators.starters import STAGES

HEADING = rf"\A#{{1,6}}[{WS_INLINE}]+[^{LINE_ENDS}]+\z"


def section_of_lines(files: DataFrame, key: str = "file_ord") -> DataFrame:
    """``key, pos, section``: how many headings precede or are each line."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = files.select(key, F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    is_heading = F.col("line").rlike(HEADING).cast("bigint")
    return lines.select(key, "pos", F.sum(is_heading).over(so_far).alias("section"))


# --- README fields; inputs have ``owner, repo, content`` ----------------------------------------------


def readme_title(content: Column) -> Column:
    """First ``# `` heading, or empty."""
    lines = F.transform(F.split(content, "\n"), js_trim)
    return js_trim(F.substring(F.coalesce(F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0)), F.lit("")), 3, 1 << 20))


def readme_description(content: Column) -> Column:
    """First line that is no heading and longer than twenty characters, or empty."""
    lines = F.transform(F.split(content, "\n"), js_trim)
    return F.coalesce(F.get(F.filter(lines, lambda x: ~x.startswith("#") & (F.length(x) > 20)), F.lit(0)), F.lit(""))


def readme_bullets(content: Column, section: str) -> Column:
    """Bullets below ``## {section}`` up to the next second-level heading."""
    pattern = rf"(?im)^##\s+{section}\s*\n((?s:.*?))(?=^##\s|\z)"
    block = F.regexp_extract(content, pattern, 1)
    bullets = F.filter(F.transform(F.split(block, "\n"), js_trim), lambda x: x.rlike(r"\A[-*]"))
    texts = F.transform(bullets, lambda x: js_trim(F.regexp_replace(x, r"\A[-* ]+", "")))
    return F.filter(texts, lambda x: x != "")


def _cells(line: Column) -> Column:
    """Trimmed cells without the empty ones outside the outer bars."""
    inner = F.regexp_replace(F.regexp_replace(line, r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|"), js_trim)


def stack_table(readmes: DataFrame) -> DataFrame:
    """Languages, frameworks and features per stage from the first table of a README.

    Adds ``has_table, has_features_row`` and one ``struct<buildDeploy, applicationStack, postDeploy>`` per
    category.  The table is the first run of lines that start with a bar; it needs a header, a
    separator and one row.
    """
    table = F.regexp_extract(F.concat(F.lit("\n"), "content"), r"\n[ \t]*(\|[^\n]*(?:\n[ \t]*\|[^\n]*)*)", 1)
    rows = F.transform(F.split(table, "\n"), js_trim)
    df = readmes.withColumn("_rows", F.when(table != "", rows).otherwise(F.array().cast("array<string>")))
    lower = lambda c: F.lower(c)
    df = df.withColumn("_header", F.transform(_cells(F.coalesce(F.get("_rows", F.lit(0)), F.lit(""))), lower))

    def matches(stage: str):
        def test(cell: Column) -> Column:
            build = cell.contains("build") & cell.contains("deploy")
            application = cell.contains("application") & cell.contains("stack")
            post = cell.contains("post") & cell.contains("deploy")
            return {
                "buildDeploy": build,
                "applicationStack": ~build & application,
                "postDeploy": ~build & ~application & post,
            }[stage]

        return test

    # The last matching column counts.
    for stage in STAGES:
        marks = F.transform("_header", matches(stage))
        position = F.size(marks) - F.array_position(F.reverse(marks), True).cast("int")
        df = df.withColumn(f"_at_{stage}", F.when(F.array_contains(marks, True), position))
    is_table = (F.size("_rows") >= 3) & (F.col("_at_buildDeploy").isNotNull() | F.col("_at_applicationStack").isNotNull())
    data = F.slice("_rows", F.lit(3), F.greatest(F.size("_rows") - 2, F.lit(0)))
    df = df.withColumns({"has_table": is_table, "_data": F.transform(data, _cells)})
    empty = F.array().cast("array<string>")

    def label(cells: Column) -> Column:
        return F.lower(js_trim(F.regexp_replace(F.get(cells, F.lit(0)), r"\*\*|__", "")))

    def values(category: str, stage: str) -> Column:
        # The last row of that label that is long enough counts.
        at = F.col(f"_at_{stage}")
        row = F.try_element_at(F.filter("_data", lambda c: (label(c) == category) & (F.size(c) > at)), F.lit(-1))
        cell = F.get(row, at)
        items = F.filter(F.transform(F.split(cell, ","), js_trim), lambda v: v != "")
        return F.when(F.col("has_table") & cell.isNotNull() & (cell != "-"), items).otherwise(empty)

    categories = {
        c: F.struct(*[values(c, stage).alias(stage) for stage in STAGES]) for c in ("languages", "frameworks", "features")
    }
    has_features = F.col("has_table") & F.exists("_data", lambda cells: label(cells) == "features")
    df = df.withColumn("has_features_row", has_features).withColumns(categories)
    return df.drop("_rows", "_header", "_data", *[f"_at_{s}" for s in STAGES])
