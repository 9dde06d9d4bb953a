"""Version histories: current rows, lookups by version or id, and update checks.

``versions`` has ``category, name, version_id, version, last_modified`` and whatever else describes a
version.  Every lookup first reduces the history to one row per lookup key, so a template with a huge
history and many requests never produces their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.versions import (
    HUMAN_READABLE_VERSION,
    SHORT_VERSION,
    major,
    semver_part,
    version_format,
    version_parts,
)
from shelfmark.operators.ranking import first_wins, numbered

KEY = ["category", "name"]
NO_CHANGELOG = "No changelog available"
RESOLUTION_FAILED = "VERSION_RESOLUTION_FAILED"
NOT_FOUND = "TEMPLATE_NOT_FOUND"
MISSING_FIELDS = "category, templateName, and currentVersion are required"


def _newest_first() -> list[Column]:
    return [F.col("last_modified").desc(), F.col("version_id")]


def version_history(versions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All versions with ``position`` 1 for the newest, and ``is_latest``."""
    if wanted is not None:
        versions = versions.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    ranked = numbered(versions, KEY, _newest_first(), "position")
    if "is_latest" not in versions.columns:
        ranked = ranked.withColumn("is_latest", F.col("position") == 1)
    return ranked


def history_errors(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """``category, name, code, message`` of wanted templates without any version: an error row each, however often it is asked for.

    A null category or name is no template, and an error as well.
    """
    asked, there = wanted.select(*KEY).distinct(), versions.select(*KEY).distinct()
    named = F.concat_ws("/", F.coalesce("category", F.lit("")), F.coalesce("name", F.lit("")))
    return asked.join(there, KEY, "left_anti").select(
        *KEY, F.lit(NOT_FOUND).alias("code"), F.concat(F.lit("Template not found: "), named).alias("message")
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """The newest version of every template."""
    return first_wins(versions, KEY, _newest_first())


def match_versions(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """The version each want selects; null columns when none does.

    ``wanted`` has ``want_id, category, name, version, version_id``.  With both criteria the newest
    version matching either is taken; a version alone is compared to the current object only; an id
    alone selects that version; neither selects the current object.
    """
    rows = F.struct("version_id", "version", "last_modified", "size").alias("hit")
    history = versions.select(*KEY, "version_id", "version", "last_modified", "size")
    current = current_versions(history)

    def keyed(df: DataFrame, kind: str, value: Column) -> DataFrame:
        return df.select(*KEY, F.lit(kind).alias("kind"), value.alias("value"), rows)

    newest_match = (
        keyed(history, "semver", semver_part(F.col("version")))
        .unionByName(keyed(history, "id", F.col("version_id")))
        .where(F.col("value").isNotNull())
    )
    lookup = first_wins(
        newest_match, [*KEY, "kind", "value"], [F.col("hit.last_modified").desc(), F.col("hit.version_id")]
    )
    lookup = lookup.unionByName(
        keyed(current, "current_semver", semver_part(F.col("version"))).where(F.col("value").isNotNull())
    ).unionByName(keyed(current, "current", F.lit("")))

    has_version, has_id = F.col("version").isNotNull(), F.col("version_id").isNotNull()
    semver = semver_part(F.col("version"))

    def probe(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    probes = (
        F.when(has_version & has_id, F.array(probe("semver", semver), probe("id", F.col("version_id"))))
        .when(has_version, F.array(probe("current_semver", semver)))
        .when(has_id, F.array(probe("id", F.col("version_id"))))
        .otherwise(F.array(probe("current", F.lit(""))))
    )
    hits = (
        wanted.select("want_id", *KEY, F.explode(probes).alias("p"))
        .select("want_id", *KEY, "p.kind", "p.value")
        .join(lookup, [*KEY, "kind", "value"])
    )
    # At most two hits per want.
    best = hits.groupBy("want_id").agg(
        F.max_by("hit", F.struct("hit.last_modified", "hit.version_id")).alias("hit")
    )
    return (
        wanted.withColumnsRenamed({"version": "want_version", "version_id": "want_version_id"})
        .join(best, "want_id", "left")
        .select("want_id", *KEY, "want_version", "want_version_id", "hit.*")
    )


def short_version_lookup(versions: DataFrame) -> DataFrame:
    """``category, name, short, full``: the newest version that starts with each short form.

    A short form is a prefix, so ``v1.3.4`` also finds ``v1.3.40/...``: every version is listed under
    all the short forms it starts with, which are as many as its patch number has digits.
    """
    shape = r"\A(v\d+\.\d+\.)(\d+)"
    patch = F.regexp_extract("version", shape, 2)
    shorts = F.transform(
        F.sequence(F.lit(1), F.length(patch)),
        lambda n: F.concat(F.regexp_extract("version", shape, 1), F.substring(patch, F.lit(1), n)),
    )
    listed = versions.where(F.col("version").rlike(shape)).select(
        *KEY, "version", "version_id", "last_modified", F.explode(shorts).alias("short")
    )
    return first_wins(listed, [*KEY, "short"], _newest_first()).select(*KEY, "short", F.col("version").alias("full"))


def resolve_short(requests: DataFrame, versions: DataFrame, column: str = "current_version") -> DataFrame:
    """Adds ``resolved_version``; a short form without a match stays as it is."""
    lookup = short_version_lookup(versions).withColumnRenamed("short", column)
    return requests.join(lookup, [*KEY, column], "left").withColumn(
        "resolved_version", F.coalesce("full", column)
    ).drop("full")


def resolve_id(requests: DataFrame, versions: DataFrame, column: str = "current_version") -> DataFrame:
    """Adds ``resolved_version`` and ``error``; an unknown id is an error, and of repeated ids the newest row counts."""
    lookup = first_wins(versions, [*KEY, "version_id"], _newest_first()).select(
        *KEY, F.col("version_id").alias(column), F.col("version").alias("resolved_version"), F.lit(True).alias("_known")
    )
    return (
        requests.join(lookup, [*KEY, column], "left")
        .withColumn("error", F.when(F.col("_known").isNull(), RESOLUTION_FAILED))
        .drop("_known")
    )


def resolve_versions(requests: DataFrame, versions: DataFrame, column: str = "current_version") -> DataFrame:
    """Full versions pass, short forms and ids are resolved through the history."""
    fmt = version_format(F.col(column))
    formatted = requests.withColumn("version_format", fmt)
    none = F.lit(None).cast("string")
    full = formatted.where(F.col("version_format") == HUMAN_READABLE_VERSION)
    short = formatted.where(F.col("version_format") == SHORT_VERSION)
    ids = formatted.where(~F.col("version_format").isin(HUMAN_READABLE_VERSION, SHORT_VERSION))
    return (
        full.withColumn("resolved_version", F.col(column))
        .withColumn("error", none)
        .unionByName(resolve_short(short, versions, column).withColumn("error", none))
        .unionByName(resolve_id(ids, versions, column))
    )


def check_updates(installed: DataFrame, versions: DataFrame) -> DataFrame:
    """Compare installed templates with the current versions.

    ``installed`` has ``row_id, category, name, current_version``.  An update is available whenever the
    two version strings differ, also when the installed one is newer.
    """
    blank = [F.coalesce(F.col(c), F.lit("")) == "" for c in (*KEY, "current_version")]
    incomplete = blank[0] | blank[1] | blank[2]
    resolved = resolve_versions(installed.where(~incomplete), versions)
    newest = current_versions(versions)
    changelog = F.col("description") if "description" in versions.columns else F.lit(None).cast("string")
    latest = newest.select(
        *KEY,
        F.col("version").alias("latest_version"),
        F.coalesce(F.nullif(changelog, F.lit("")), F.lit(NO_CHANGELOG)).alias("changelog"),
        F.lit(True).alias("_exists"),
    )
    now, then = major(F.col("latest_version")), major(F.col("resolved_version"))
    ok = F.col("error").isNull()
    guide = F.concat(
        F.lit("docs/templates/v2/"), F.lower("category"), F.lit("/"), F.col("name"),
        F.lit("-README.md#migration-from-v"), then, F.lit("x-to-v"), now, F.lit("x"),
    )
    compared = (
        resolved.join(latest, KEY, "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("_exists").isNull(), NOT_FOUND)))
        .select(
            "row_id",
            *KEY,
            F.when(F.col("error") == RESOLUTION_FAILED, F.col("current_version"))
            .otherwise(F.col("resolved_version"))
            .alias("current_version"),
            F.when(ok, F.col("latest_version")).alias("latest_version"),
            F.when(ok, ~F.col("resolved_version").eqNullSafe(F.col("latest_version")))
            .otherwise(False)
            .alias("update_available"),
            F.when(ok, version_parts(F.col("latest_version"))["date"]).alias("release_date"),
            F.when(ok, F.col("changelog")).alias("changelog"),
            F.when(ok, now > then).alias("breaking_changes"),
            F.when(ok & (now > then), guide).alias("migration_guide"),
            "error",
        )
    )
    rejected = installed.where(incomplete).select(
        "row_id", *KEY, "current_version", F.lit(MISSING_FIELDS).alias("error")
    )
    return compared.unionByName(rejected, allowMissingColumns=True)
