"""Sidecar metadata of repositories from their files and the hosting API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import release_version
from shelfmark.operators import packages as P
from shelfmark.operators import readme as R
from shelfmark.operators.ranking import first_wins
from shelfmark.operators.starters import DEFAULT_REPOSITORY_TYPE, STAGES

UNLICENSED = "UNLICENSED"


def _texts() -> Column:
    return F.array().cast("array<string>")


def _text(*values: Column, default: str = "") -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def _staged(stack: Column) -> Column:
    """Categorised value with everything in the application stack."""
    return F.struct(*[(stack if s == "applicationStack" else _texts()).alias(s) for s in STAGES])


def local_metadata(files: DataFrame, cache_package: str, cache_feature: str) -> DataFrame:
    """What the files alone tell; one row per repository."""
    readmes = R.stack_table(P.root_readmes(files)).select(
        *P.REPO,
        R.readme_title(F.col("content")).alias("display_name"),
        R.readme_description(F.col("content")).alias("readme_description"),
        R.readme_bullets(F.col("content"), "Prerequisites").alias("readme_prerequisites"),
        "has_table",
        "has_features_row",
        *[F.col(c).alias(f"table_{c}") for c in ("languages", "frameworks", "features")],
    )
    df = (
        P.path_features(files)
        .join(P.package_metadata(files, cache_package), P.REPO, "left")
        .join(P.requirements(files), P.REPO, "left")
        .join(P.root_dependencies(files), P.REPO, "left")
        .join(readmes, P.REPO, "left")
    )
    has_package, has_requirements = F.col("name").isNotNull(), F.col("requirements").isNotNull()
    languages = F.array_compact(F.array(F.when(has_package, "Node.js"), F.when(has_requirements, "Python")))
    root = F.coalesce("root_dependencies", _texts())
    table, features_row = F.coalesce("has_table", F.lit(False)), F.coalesce("has_features_row", F.lit(False))
    df = df.withColumns(
        {
            "_languages": languages,
            "_frameworks": P.frameworks(root, F.coalesce("requirements_text", F.lit(""))),
            "_features": P.features(F.array_contains(root, cache_package), cache_feature),
        }
    )
    prerequisites = F.concat(
        P.inferred_prerequisites(F.col("_languages"), F.col("has_template_yml")), F.coalesce("readme_prerequisites", _texts())
    )
    return df.select(
        *P.REPO,
        _text(F.col("name")).alias("name"),
        _text(F.col("display_name")).alias("display_name"),
        _text(F.col("description"), F.col("readme_description")).alias("description"),
        F.when(table, F.col("table_languages")).otherwise(_staged(F.col("_languages"))).alias("languages"),
        F.when(table, F.col("table_frameworks")).otherwise(_staged(F.col("_frameworks"))).alias("frameworks"),
        F.when(features_row, F.col("table_features")).otherwise(_staged(F.col("_features"))).alias("features"),
        F.array_distinct(prerequisites).alias("prerequisites"),
        F.array_distinct(
            F.concat(F.coalesce("dependencies", _texts()), F.coalesce("requirements", _texts()))
        ).alias("dependencies"),
        F.coalesce("dev_dependencies", _texts()).alias("dev_dependencies"),
        F.coalesce("has_cache_data", F.lit(False)).alias("has_cache_data"),
        _text(F.col("author")).alias("author"),
        _text(F.col("license"), default=UNLICENSED).alias("license"),
        _text(F.col("version")).alias("version"),
    )


def repo_metadata(
    files: DataFrame,
    api_repos: DataFrame,
    releases: DataFrame,
    types: DataFrame,
    cache_package: str,
    cache_feature: str,
    default_platform: str = "",
) -> DataFrame:
    """Sidecar metadata: local values first, then those of the API; a release beats the package version.

    ``api_repos`` has ``owner, repo, name, description, author, license, topics, updated_at``;
    ``releases`` has ``owner, repo, tag_name, published_at``; ``types`` has ``owner, repo, repository_type``.
    """
    api = api_repos.select(*P.REPO, *[F.col(c).alias(f"api_{c}") for c in
                                      ("name", "description", "author", "license", "topics", "updated_at")],
                           F.lit(True).alias("_api"))
    latest = first_wins(releases, P.REPO, [F.col("published_at").desc(), "tag_name"]).select(
        *P.REPO, release_version(F.col("tag_name"), F.col("published_at")).alias("release_version")
    )
    merged = (
        local_metadata(files, cache_package, cache_feature)
        .join(api, P.REPO, "left")
        .join(latest, P.REPO, "left")
        .join(types, P.REPO, "left")
    )
    on_host = F.col("_api").isNotNull()
    license_name = F.when(
        on_host & (F.col("license") == UNLICENSED), F.coalesce("api_license", F.lit(UNLICENSED))
    ).otherwise(F.col("license"))
    return merged.select(
        *P.REPO,
        _text(F.col("name"), F.col("api_name")).alias("name"),
        "display_name",
        _text(F.col("description"), F.col("api_description")).alias("description"),
        "languages",
        "frameworks",
        "features",
        F.array_distinct(F.coalesce("api_topics", _texts())).alias("topics"),
        "prerequisites",
        "dependencies",
        "dev_dependencies",
        "has_cache_data",
        F.lit(default_platform).alias("deployment_platform"),
        F.concat(F.lit("github.com/"), "owner", F.lit("/"), "repo").alias("repository"),
        _text(F.col("author"), F.col("api_author")).alias("author"),
        license_name.alias("license"),
        _text(F.col("repository_type"), default=DEFAULT_REPOSITORY_TYPE).alias("repository_type"),
        _text(F.col("release_version"), F.col("version")).alias("version"),
        F.col("api_updated_at").alias("last_updated"),
    )
