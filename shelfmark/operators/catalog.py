"""Catalog objects merged from prioritised sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.versions import build_key, key_category, key_name, object_uri
from shelfmark.operators.ranking import first_wins

TEMPLATE_BASE = "templates/v2"
STARTER_BASE = "app-starters/v2"
#: Point lookups try these in order.
TEMPLATE_EXTENSIONS = ["yml", "yaml"]
ANY_NAMESPACE = "*"

# The configured categories and their descriptions.
CATEGORIES = {
    "storage": "S3 buckets, DynamoDB tables, and data storage resources",
    "network": "CloudFront distributions, Route53, VPC, and networking resources",
    "pipeline": "CodePipeline, CodeBuild, and CI/CD infrastructure",
    "service-role": "IAM roles and policies for AWS services",
    "modules": "Reusable CloudFormation definitions and nested stacks",
}


def allowed_sources(requested: Sequence[str] | None, configured: Sequence[str], strict: bool = True) -> list[str]:
    """The requested sources that are configured, in request order; all configured ones if none is requested.

    ``strict`` raises when nothing is left (listing); lookups use an empty list instead.
    """
    if not requested:
        return list(configured)
    kept = [s for s in requested if s in set(configured)]
    if strict and not kept:
        raise ValueError("No valid sources specified")
    return kept


def source_order(source: Column, sources: Sequence[str]) -> Column:
    """Zero-based priority of a source; null when it is not in the list."""
    order = F.lit(None).cast("int")
    for i, name in enumerate(sources):
        order = F.when(source == name, i).otherwise(order)
    return order


def from_sources(df: DataFrame, sources: Sequence[str], column: str = "bucket") -> DataFrame:
    """Rows of the given sources with their priority in ``src_ord``."""
    return df.where(F.col(column).isin(list(sources))).withColumn("src_ord", source_order(F.col(column), sources))


def discover_namespaces(listing: DataFrame) -> DataFrame:
    """``bucket, namespace, ns_ord``: the root prefixes of every bucket in key order."""
    roots = (
        listing.where(F.col("key").contains("/"))
        .select("bucket", F.split("key", "/")[0].alias("namespace"))
        .where("namespace <> ''")
        .distinct()
    )
    order = Window.partitionBy("bucket").orderBy("namespace")
    return roots.withColumn("ns_ord", F.row_number().over(order))


def parse_objects(
    listing: DataFrame, base: str = TEMPLATE_BASE, extensions: Sequence[str] = tuple(TEMPLATE_EXTENSIONS)
) -> DataFrame:
    """Objects below ``{namespace}/{base}/`` with one of the extensions, and what their keys say."""
    pattern = "|".join(extensions)
    key = F.col("key")
    return listing.where(key.rlike(rf"\A[^/]+/{base}/.*\.({pattern})\z")).select(
        "*",
        F.split(key, "/")[0].alias("namespace"),
        key_category(key).alias("category"),
        key_name(key, pattern).alias("name"),
        F.regexp_extract(key, r"\.([^.]*)\z", 1).alias("extension"),
        object_uri(F.col("bucket"), key).alias("s3_path"),
    )


def list_catalog(
    listing: DataFrame,
    sources: Sequence[str],
    category: str | None = None,
    namespace: str | None = None,
    base: str = TEMPLATE_BASE,
) -> DataFrame:
    """Templates of all sources; per category and name the first source, namespace and key wins."""
    objects = from_sources(parse_objects(listing, base), sources)
    if namespace:
        # A prefix test as well, so that the source can skip other prefixes.
        objects = objects.where(F.col("key").startswith(f"{namespace}/") & (F.col("namespace") == namespace))
    if category:
        objects = objects.where(F.col("category") == category)
    return first_wins(objects, ["category", "name"], ["src_ord", "namespace", "key"])


def category_counts(catalog: DataFrame, categories: DataFrame) -> DataFrame:
    """All configured categories with the number of their templates, zero included."""
    counts = catalog.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(counts, categories["name"] == counts["category"], "left").select(
        "name", "description", F.coalesce("n", F.lit(0)).alias("template_count")
    )


def configured_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "name string, description string")


def resolve_objects(wanted: DataFrame, listing: DataFrame, sources: Sequence[str], base: str = TEMPLATE_BASE) -> DataFrame:
    """First hit of every want over source, namespace and extension order; null columns when there is none.

    ``wanted`` has ``want_id, category, name`` and optionally ``namespace``.  The listing is reduced to
    one row per lookup key before the join, so many wants for one object never meet many copies of it.
    """
    if "namespace" not in wanted.columns:
        wanted = wanted.withColumn("namespace", F.lit(None).cast("string"))
    objects = from_sources(parse_objects(listing, base), sources)
    # Only the key the point lookup would build counts, not objects deeper below the prefix.
    exact = F.col("key") == build_key(
        F.col("namespace"), base, F.col("category"), F.col("name"), F.concat(F.lit("."), F.col("extension"))
    )
    ext_ord = source_order(F.col("extension"), TEMPLATE_EXTENSIONS)
    lookup = first_wins(
        objects.where(exact).withColumn("lookup_ns", F.explode(F.array("namespace", F.lit(ANY_NAMESPACE)))),
        ["category", "name", "lookup_ns"],
        ["src_ord", "namespace", ext_ord],
    ).select("category", "name", "lookup_ns", "bucket", F.col("namespace").alias("found_namespace"), "key", "s3_path",
             "last_modified", "size")
    wants = wanted.withColumn("lookup_ns", F.coalesce("namespace", F.lit(ANY_NAMESPACE)))
    return wants.join(lookup, ["category", "name", "lookup_ns"], "left").drop("lookup_ns")


def not_found(resolved: DataFrame) -> DataFrame:
    """Unmatched wants as error rows."""
    return resolved.where(F.col("key").isNull()).select(
        "want_id",
        "category",
        "name",
        F.lit("TEMPLATE_NOT_FOUND").alias("code"),
        F.concat(F.lit("Template not found: "), "category", F.lit("/"), "name").alias("message"),
    )


def available_names(missing: DataFrame, catalog: DataFrame) -> DataFrame:
    """``category, available``: the names on offer in every category something was missed in.

    One row per name; join it to ``missing`` by category to show the offers next to an error.
    """
    categories = missing.select("category").distinct()
    return (
        catalog.select("category", F.col("name").alias("available"))
        .distinct()
        .join(categories, "category", "left_semi")
    )


def union_sources(
    spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], source_type: str = "s3"
) -> tuple[DataFrame, DataFrame, bool]:
    """``(rows, errors, partial)``: what every source gives; a source that fails becomes an error row."""
    frames, failures = [], []
    for name, read in readers.items():
        try:
            frames.append(read().withColumn("source", F.lit(name)))
        except (PySparkException, OSError, ValueError) as error:
            failures.append((name, source_type, str(error)))
    errors = spark.createDataFrame(failures, "source string, source_type string, error string").withColumn(
        "timestamp", F.current_timestamp()
    )
    if not frames:
        return spark.createDataFrame([], "source string"), errors, bool(failures)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows, errors, bool(failures)


def changed_items(before: DataFrame, after: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Items added, removed or changed between two sides: ``keys, item, change, before, after``."""
    left = before.select(*keys, item, F.col(value).alias("before"), F.lit(True).alias("_left"))
    right = after.select(*keys, item, F.col(value).alias("after"), F.lit(True).alias("_right"))
    change = (
        F.when(F.col("_left").isNull(), "added")
        .when(F.col("_right").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    both = left.join(right, [*keys, item], "full").withColumn("change", change)
    return both.where(F.col("change").isNotNull()).drop("_left", "_right")


def compare_arrays(left: Column, right: Column) -> Column:
    """struct(only_left, only_right, both) of two item arrays."""
    return F.struct(
        F.array_except(left, right).alias("only_left"),
        F.array_except(right, left).alias("only_right"),
        F.array_intersect(left, right).alias("both"),
    )
