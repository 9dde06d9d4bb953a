"""Version strings, object keys and error categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and names.
HUMAN_PATTERN = r"\Av\d+\.\d+\.\d+/\d{4}-\d{2}-\d{2}\z"
SHORT_PATTERN = r"\Av\d+\.\d+\.\d+\z"
HEADER_PATTERN = r"(?m)^#\s*Version:\s*(v[\d.]+/\d{4}-\d{2}-\d{2})"
HUMAN_READABLE_VERSION = "HUMAN_READABLE_VERSION"
SHORT_VERSION = "SHORT_VERSION"
S3_VERSION_ID = "S3_VERSION_ID"
STATUS_BY_CATEGORY = {
    "CLIENT_ERROR": 400,
    "VALIDATION_ERROR": 400,
    "NOT_FOUND": 404,
    "RATE_LIMIT": 429,
    "SERVER_ERROR": 500,
    "CACHE_ERROR": 500,
    "EXTERNAL_SERVICE": 500,
}


def index_version(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def human_version(content: Column) -> Column:
    """Version in the header comment, or null."""
    return F.nullif(F.regexp_extract(content, HEADER_PATTERN, 1), F.lit(""))


def version_format(version: Column) -> Column:
    return (
        F.when(version.rlike(HUMAN_PATTERN), HUMAN_READABLE_VERSION)
        .when(version.rlike(SHORT_PATTERN), SHORT_VERSION)
        .otherwise(S3_VERSION_ID)
    )


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))


def major(version: Column) -> Column:
    return F.when(version.isNull(), 0).otherwise(_number(version, r"v(\d+)\.", 1))


def version_parts(version: Column) -> Column:
    """struct(version, date, major, minor, patch); a null version gives nulls and zeros."""
    semver = r"v(\d+)\.(\d+)\.(\d+)"
    head = F.split(version, "/")[0]
    date = F.when(version.isNotNull(), F.coalesce(F.get(F.split(version, "/"), F.lit(1)), F.lit("")))
    numbers = [
        F.when(head.isNull(), 0).otherwise(_number(head, semver, i)).alias(name)
        for i, name in enumerate(("major", "minor", "patch"), start=1)
    ]
    return F.struct(head.alias("version"), date.alias("date"), *numbers)


def semver_part(version: Column) -> Column:
    return F.split(version, "/")[0]


def versions_match(version: Column, wanted: Column) -> Column:
    """Equal, or equal in the part before the slash."""
    return F.coalesce(semver_part(version) == semver_part(wanted), F.lit(False))


def build_key(namespace: Column, base: Column | str, category: Column, name: Column, extension: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.concat_ws("/", namespace, base, category, name), extension)


def key_category(key: Column) -> Column:
    return F.try_element_at(F.split(key, "/"), F.lit(-2))


def key_name(key: Column, extensions: str = "yml|yaml") -> Column:
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), rf"\.({extensions})\z", "")


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def status_of(category: Column) -> Column:
    status = F.lit(500)
    for name, code in STATUS_BY_CATEGORY.items():
        status = F.when(category == name, code).otherwise(status)
    return status
