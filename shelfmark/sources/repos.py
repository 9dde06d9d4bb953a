"""Landed hosting-API documents: repositories, releases, properties and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import decode_base64
from shelfmark.operators.ranking import first_wins

REPO_SCHEMA = (
    "id bigint, name string, full_name string, description string, private boolean, html_url string, clone_url string, "
    "ssh_url string, default_branch string, language string, stargazers_count bigint, forks_count bigint, "
    "watchers_count bigint, open_issues_count bigint, size bigint, created_at string, updated_at string, pushed_at string"
)
RELEASE_SCHEMA = (
    "id bigint, tag_name string, name string, body string, draft boolean, prerelease boolean, created_at string, "
    "published_at string, html_url string, zipball_url string, author struct<login: string, avatar_url: string, html_url: string>"
)
README_SCHEMA = "name string, path string, content string, size bigint, html_url string, download_url string"

# The recognised repository types.
REPOSITORY_TYPES = ["documentation", "app-starter", "templates", "management", "package", "mcp"]
API_ROOT = "https://api.github.com"


def parse_documents(landed: DataFrame, schema: str, column: str = "document") -> DataFrame:
    """JSON documents of a known schema as columns; unreadable fields are null."""
    others = [c for c in landed.columns if c != column]
    return landed.withColumn("_d", F.from_json(column, schema)).select(*others, "_d.*")


def list_repos(organisation_repos: DataFrame, user_repos: DataFrame) -> DataFrame:
    """``owner, src_ord, ...`` repositories: those of the organisation, or of the user where there is no such organisation.

    Both inputs hold ``owner, src_ord`` and the fields of ``REPO_SCHEMA``.
    """
    known = organisation_repos.select("owner").distinct()
    fallback = user_repos.join(known, "owner", "left_anti")
    branch = F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main"))
    return organisation_repos.unionByName(fallback).withColumn("default_branch", branch)


def select_archives(repos: DataFrame, releases: DataFrame) -> DataFrame:
    """``owner, name, archive_url``: the latest published release, else the default branch.

    ``releases`` has ``owner, repo`` and the fields of ``RELEASE_SCHEMA``.
    """
    published = releases.where(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False)))
    latest = first_wins(published, ["owner", "repo"], [F.col("published_at").desc(), F.col("id").desc()]).select(
        "owner", F.col("repo").alias("name"), "tag_name", "zipball_url"
    )
    branch = F.concat_ws("/", F.lit(f"{API_ROOT}/repos"), "owner", "name", F.lit("zipball"), "default_branch")
    return repos.join(latest, ["owner", "name"], "left").select(
        "owner", "name", "tag_name", F.coalesce("zipball_url", branch).alias("archive_url")
    )


def typed_repos(repos: DataFrame, properties: DataFrame, property_name: str, repository_type: str | None = None) -> DataFrame:
    """Repositories with their type; those without the property are left out.

    ``properties`` has ``owner, repo, property_name, value``.
    """
    types = properties.where((F.col("property_name") == property_name) & (F.coalesce("value", F.lit("")) != ""))
    if repository_type:
        types = types.where(F.col("value") == repository_type)
    types = types.select("owner", F.col("repo").alias("name"), F.col("value").alias("repository_type"))
    return repos.join(types, ["owner", "name"])


def first_repo_per_name(repos: DataFrame) -> DataFrame:
    """One repository per name, ignoring case, from the first source that has it."""
    return first_wins(repos, [F.lower("name")], ["src_ord", "name"])


def repo_details(repos: DataFrame, readmes: DataFrame, releases: DataFrame) -> DataFrame:
    """Repository counts and dates with the decoded README and the latest release.

    ``readmes`` has ``owner, repo`` and the fields of ``README_SCHEMA``.
    """
    texts = readmes.select(
        "owner", F.col("repo").alias("name"), F.col("path").alias("readme_path"), decode_base64(F.col("content")).alias("readme")
    )
    latest = first_wins(releases, ["owner", "repo"], [F.col("published_at").desc(), F.col("id").desc()]).select(
        "owner",
        F.col("repo").alias("name"),
        F.struct("tag_name", F.col("name").alias("title"), "published_at", F.col("author.login").alias("author")).alias("release"),
    )
    stats = repos.select(
        "owner",
        "name",
        F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"),
        F.col("watchers_count").alias("watchers"),
        F.col("open_issues_count").alias("open_issues"),
        "size",
        "language",
        F.col("updated_at").alias("last_updated"),
        "created_at",
        "pushed_at",
    )
    return stats.join(texts, ["owner", "name"], "left").join(latest, ["owner", "name"], "left")


def release_list(releases: DataFrame) -> DataFrame:
    """All releases with flattened author fields."""
    return releases.select(
        "owner", "repo", "id", "tag_name", "name", "body", "draft", "prerelease", "created_at", "published_at",
        F.col("html_url").alias("url"), F.col("author.login").alias("author_login"),
        F.col("author.avatar_url").alias("author_avatar"), F.col("author.html_url").alias("author_url"),
    )
