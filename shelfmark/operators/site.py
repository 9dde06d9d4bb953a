"""Whole documentation sites: settings, overlays and what a deployment changes.

``pages`` has ``path, html``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.site import (
    breadcrumb,
    html_title,
    inject_breadcrumb,
    inject_footer,
    occurrences,
    rewrite_links,
    setting_token,
)
from shelfmark.functions.text import placeholders
from shelfmark.operators.ranking import last_wins

#: Name under which replaced gateway addresses are counted.
URL_COUNT = "apiGatewayUrl"


def overlay_settings(settings: dict[str, dict[str, str]], stage: str) -> dict[str, str]:
    """Defaults with the values of a stage over them."""
    return {**(settings.get("default") or {}), **(settings.get(stage) or {})}


def overlay_setting_rows(defaults: DataFrame, stage: DataFrame) -> DataFrame:
    """The same for ``key, value`` tables."""
    staged = stage.select("key", F.col("value").alias("_stage"), F.lit(True).alias("_set"))
    return defaults.join(staged, "key", "full").select(
        "key", F.when(F.col("_set").isNotNull(), F.col("_stage")).otherwise(F.col("value")).alias("value")
    )


def apply_settings(pages: DataFrame, settings: dict[str, str], api_url: str | None = None) -> DataFrame:
    """Adds ``new_html`` and ``counts``: settings tokens, then the gateway address, replaced and counted.

    The address becomes ``https://{domain}``, so it is replaced only if ``domain`` is set.
    """
    replacements = [(key, setting_token(key), value) for key, value in settings.items()]
    if api_url and settings.get("domain"):
        replacements.append((URL_COUNT, api_url, f"https://{settings['domain']}"))
    df = pages.withColumn("new_html", F.col("html"))
    counts = []
    for i, (key, token, value) in enumerate(replacements):
        df = df.withColumns(
            {
                f"_n{i}": occurrences(F.col("new_html"), token),
                "new_html": F.replace("new_html", F.lit(token), F.lit(value)),
            }
        )
        counts.append(F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(key).alias("key"), F.col(f"_n{i}").alias("count"))))
    found = F.array_compact(F.array(*counts)) if counts else F.array().cast("array<struct<key:string,count:bigint>>")
    return df.withColumn("counts", F.map_from_entries(found)).drop(*[f"_n{i}" for i in range(len(replacements))])


def changed_pages(applied: DataFrame) -> DataFrame:
    """Pages to write back."""
    return applied.where(F.col("html") != F.col("new_html")).drop("html").withColumnRenamed("new_html", "html")


def replacement_totals(applied: DataFrame) -> DataFrame:
    """Replacements per token over all changed pages."""
    changed = applied.where(F.col("html") != F.col("new_html"))
    # Exploding an expression, not a column: for a column Spark would add a filter on its size and work
    # the whole rewriting out again for it.
    pairs = changed.select(F.inline(F.map_entries("counts")))
    return pairs.groupBy("key").agg(F.sum("value").alias("replacements"))


def page_navigation(pages: DataFrame) -> DataFrame:
    """Links rewritten, breadcrumb and footer added; the directory is the last one of the path."""
    parts = F.split("path", "/")
    directory = F.element_at(parts, -2)
    title = F.when(F.element_at(parts, -1) != "index.html", html_title(F.col("html"), F.col("path")))
    linked = pages.withColumns({"html": rewrite_links(F.col("html")), "_trail": breadcrumb(directory, title)})
    with_trail = linked.withColumn("html", inject_breadcrumb(F.col("html"), F.col("_trail"))).drop("_trail")
    return with_trail.withColumn("html", inject_footer(F.col("html")))


def overlay_trees(*layers: DataFrame) -> DataFrame:
    """Files of all layers; where a path repeats, the later layer's file stays."""
    numbered = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    return last_wins(reduce(DataFrame.unionByName, numbered), ["path"], ["layer"]).drop("layer")


def sync_plan(build: DataFrame, deployed: DataFrame) -> DataFrame:
    """``path, action``: add, update or delete, to make the deployed files those of the build.

    Texts are compared by hash, so only paths and hashes are shuffled.
    """
    new = build.select("path", F.sha2("html", 256).alias("_new"), F.lit(True).alias("_built"))
    old = deployed.select("path", F.sha2("html", 256).alias("_old"), F.lit(True).alias("_deployed"))
    action = (
        F.when(F.col("_deployed").isNull(), "add")
        .when(F.col("_built").isNull(), "delete")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    )
    return new.join(old, "path", "full").select("path", action.alias("action")).where(F.col("action").isNotNull())


def fill_placeholders(documents: DataFrame, text: str, values: dict[str, str]) -> DataFrame:
    """Adds ``filled`` and ``missing``: ``$NAME$`` replaced from ``values``; a missing name leaves the text unfilled."""
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")
    names = placeholders(F.col(text))
    found = documents.withColumns({"_values": known, "_names": names})
    missing = F.filter("_names", lambda n: ~F.map_contains_key(F.col("_values"), n))
    mark = lambda n: F.concat(F.lit("$"), n, F.lit("$"))

    def step(acc: Column, n: Column) -> Column:
        return F.replace(acc, mark(n), F.try_element_at(F.col("_values"), n))

    filled = F.aggregate("_names", F.col(text), step)
    return (
        found.withColumn("missing", missing)
        .withColumn("filled", F.when(F.size("missing") == 0, filled))
        .drop("_values", "_names")
    )
