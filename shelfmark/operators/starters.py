"""Starter archives with their sidecar metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.versions import object_uri
from shelfmark.operators.catalog import STARTER_BASE, from_sources, parse_objects
from shelfmark.operators.ranking import first_wins

STAGES = ["buildDeploy", "applicationStack", "postDeploy"]
_CATEGORIZED = ", ".join(f"{s}: array<string>" for s in STAGES)
DEFAULT_REPOSITORY_TYPE = "app-starter"

#: Every spelling a sidecar may use.
SIDECAR_SCHEMA = ", ".join(
    ["name string", "displayName string", "description string"]
    + [f"{c} struct<{_CATEGORIZED}>" for c in ("languages", "frameworks", "features")]
    + [f"{c} array<string>" for c in ("topics", "dependencies", "devDependencies", "dev_dependencies", "prerequisites")]
    + ["hasCacheData boolean", "has_cache_data boolean"]
    + [
        f"{c} string"
        for c in [
            "deploymentPlatform", "deployment_platform", "author", "license", "repository", "github_url", "githubUrl",
            "repositoryType", "repository_type", "version", "lastUpdated", "last_updated",
        ]
    ]
)

EMPTY_ARRAY = "array<string>"


def _text(*values: Column, default: str = "") -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def _array(*values: Column) -> Column:
    return F.coalesce(*values, F.array().cast(EMPTY_ARRAY))


def categorized(value: Column) -> Column:
    """Three arrays, empty where missing."""
    return F.struct(*[_array(value[s]).alias(s) for s in STAGES])


def sidecar_fields(content: Column, default_platform: str = "") -> list[Column]:
    """The 18 normalised fields of a sidecar document; an unreadable one gives all defaults."""
    doc = F.from_json(content, SIDECAR_SCHEMA)
    return [
        _text(doc["name"]).alias("sidecar_name"),
        _text(doc["displayName"]).alias("display_name"),
        _text(doc["description"]).alias("description"),
        categorized(doc["languages"]).alias("languages"),
        categorized(doc["frameworks"]).alias("frameworks"),
        categorized(doc["features"]).alias("features"),
        _array(doc["topics"]).alias("topics"),
        _array(doc["dependencies"]).alias("dependencies"),
        _array(doc["devDependencies"], doc["dev_dependencies"]).alias("dev_dependencies"),
        # Unlike the texts, an explicit false stays.
        F.coalesce(doc["hasCacheData"], doc["has_cache_data"], F.lit(False)).alias("has_cache_data"),
        _text(doc["deploymentPlatform"], doc["deployment_platform"], default=default_platform).alias("deployment_platform"),
        _array(doc["prerequisites"]).alias("prerequisites"),
        _text(doc["author"]).alias("author"),
        _text(doc["license"]).alias("license"),
        _text(doc["repository"], doc["github_url"], doc["githubUrl"]).alias("repository"),
        _text(doc["repositoryType"], doc["repository_type"], default=DEFAULT_REPOSITORY_TYPE).alias("repository_type"),
        _text(doc["version"]).alias("version"),
        _text(doc["lastUpdated"], doc["last_updated"]).alias("last_updated"),
    ]


def read_sidecars(sidecars: DataFrame, default_platform: str = "") -> DataFrame:
    """``bucket, key, content`` to normalised metadata, one row per document."""
    others = [c for c in sidecars.columns if c != "content"]
    return sidecars.select(*others, *sidecar_fields(F.col("content"), default_platform))


def stage_values(value: Column) -> Column:
    """Distinct values of the three stages in stage order."""
    return F.array_distinct(F.concat(*[value[s] for s in STAGES]))


def all_starters(
    listing: DataFrame,
    sidecars: DataFrame,
    sources: Sequence[str],
    failed_keys: DataFrame | None = None,
    default_platform: str = "",
) -> DataFrame:
    """Every archive with its sidecar, or with minimal metadata when it has none.

    ``sidecars`` has ``bucket, key, content``.  Archives whose sidecar exists but could not be read
    (``failed_keys``: ``bucket, key``) are left out.
    """
    zips = from_sources(parse_objects(listing, STARTER_BASE, ["zip"]), sources)
    zips = zips.withColumn("meta_key", F.regexp_replace("key", r"\.zip\z", ".json"))
    if failed_keys is not None:
        failed = failed_keys.select("bucket", F.col("key").alias("meta_key"))
        zips = zips.join(failed, ["bucket", "meta_key"], "left_anti")
    docs = sidecars.select("bucket", F.col("key").alias("meta_key"), "content", F.lit(True).alias("_has"))
    joined = zips.join(docs, ["bucket", "meta_key"], "left")
    has = F.col("_has").isNotNull()
    fields = sidecar_fields(F.col("content"), default_platform)
    return joined.select(
        "src_ord",
        "bucket",
        "namespace",
        "name",
        has.alias("has_sidecar_metadata"),
        F.col("s3_path").alias("s3_zip_path"),
        F.when(has, object_uri(F.col("bucket"), F.col("meta_key"))).alias("s3_metadata_path"),
        F.col("size").alias("zip_size"),
        "last_modified",
        "key",
        "_has",
        *fields,
    ).withColumn(
        # Without a sidecar the platform is unknown.
        "deployment_platform",
        F.when(F.col("_has").isNotNull(), F.col("deployment_platform")).otherwise(""),
    ).drop("_has", "sidecar_name")


def list_starters(
    listing: DataFrame,
    sidecars: DataFrame,
    sources: Sequence[str],
    failed_keys: DataFrame | None = None,
    default_platform: str = "",
) -> DataFrame:
    """Starters of all sources; per name the first source, namespace and key wins."""
    rows = all_starters(listing, sidecars, sources, failed_keys, default_platform)
    return first_wins(rows, ["name"], ["src_ord", "namespace", "key"])


def resolve_starters(
    wanted: DataFrame, listing: DataFrame, sidecars: DataFrame, sources: Sequence[str], default_platform: str = ""
) -> DataFrame:
    """``want_id, name`` to the first starter of that name; null columns when there is none."""
    starters = list_starters(listing, sidecars, sources, default_platform=default_platform)
    return wanted.join(starters, "name", "left")


def project_starters(
    starters: DataFrame, cache_feature: str, cdn_feature: str = "cloudfront"
) -> DataFrame:
    """Short listing with flags derived from the features of all stages."""
    features = stage_values(F.col("features"))
    return starters.select(
        "name",
        "description",
        features.alias("features"),
        F.col("repository").alias("url"),
        "namespace",
        F.array_contains(features, cache_feature).alias("has_cache_data"),
        F.array_contains(features, cdn_feature).alias("has_cdn"),
    )


def project_templates(catalog: DataFrame) -> DataFrame:
    """Listing rows with display defaults for version and description."""
    optional = {c: F.col(c) if c in catalog.columns else F.lit(None).cast("string") for c in ("version", "description")}
    default = F.concat(F.col("category"), F.lit(" template: "), F.col("name"))
    return catalog.select(
        "name",
        F.coalesce(F.nullif(optional["version"], F.lit("")), F.lit("unknown")).alias("version"),
        "category",
        "namespace",
        "bucket",
        F.coalesce(F.nullif(optional["description"], F.lit("")), default).alias("description"),
        "s3_path",
        "size",
    )
