from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import names as N
from shelfmark.operators import starters as S
from shelfmark.operators import versions as V
from shelfmark.operators.ranking import GROUP_LIMIT, exact_quantiles, first_wins, numbered, top_k
from shelfmark.operators.rate_limit import rate_limited
from shelfmark.operators.requests import validate_requests
from shelfmark.operators.search import ranked_search, suggestions
from shelfmark.operators.site import apply_settings, overlay_settings


def test_search_example(spark):
    postings = spark.createDataFrame(
        [("cache", "aaa", 10), ("cache", "bbb", 20), ("data", "aaa", 5), ("data", "ccc", 3), ("tie", "ddd", 5), ("tie", "eee", 5)],
        "keyword string, hash string, relevance_score int",
    )
    meta = spark.createDataFrame(
        [(h, h, "", h, "documentation", "guide", "r", "o") for h in ("aaa", "bbb", "ccc", "ddd", "eee")],
        "hash string, title string, excerpt string, content_path string, type string, sub_type string, repository string, owner string",
    )
    queries = spark.createDataFrame([(1, "cache data"), (2, "tie"), (3, "nothing"), (4, " "), (5, "to")], "query_id int, text string")
    found = ranked_search(queries, postings, meta)
    rows = [(r["query_id"], r["title"], r["relevance_score"]) for r in found.orderBy("query_id", "rank").collect()]
    assert rows == [(1, "bbb", 20), (1, "aaa", 15), (1, "ccc", 3), (2, "ddd", 5), (2, "eee", 5)]
    advice = {r["query_id"]: len(r["suggestions"]) for r in suggestions(queries, found).collect()}
    assert advice == {1: 0, 2: 0, 3: 2, 4: 1, 5: 1}


def test_filter_after_cut(spark):
    postings = spark.range(10).select(
        F.lit("key").alias("keyword"), F.col("id").cast("string").alias("hash"), (100 - F.col("id")).cast("int").alias("relevance_score")
    )
    meta = spark.range(10).select(
        F.col("id").cast("string").alias("hash"), F.lit("t").alias("title"), F.lit("").alias("excerpt"), F.lit("p").alias("content_path"),
        F.when(F.col("id") >= 5, "rare").otherwise("common").alias("type"), F.lit("").alias("sub_type"), F.lit("r").alias("repository"),
        F.lit("o").alias("owner"),
    )
    queries = spark.createDataFrame([(1, "key", "rare")], "query_id int, text string, type string")
    assert ranked_search(queries, postings, meta, limit=1, candidate_factor=3).count() == 0
    found = ranked_search(queries, postings, meta, limit=1).collect()
    assert [(r["rank"], r["total_results"]) for r in found] == [(1, 5)]


def _history(spark, *rows):
    data = [("c", "t", i, v, datetime(2024, 1, day), 1) for i, v, day in rows]
    return spark.createDataFrame(data, "category string, name string, version_id string, version string, last_modified timestamp, size int")


def test_short_versions_are_prefixes(spark):
    history = _history(spark, ("a", "v1.3.4/2024-01-10", 1), ("b", "v1.3.40/2024-02-01", 2), ("c", None, 3))
    wants = spark.createDataFrame([("c", "t", "v1.3.4"), ("c", "t", "v1.3.40"), ("c", "t", "v9.9.9")], "category string, name string, current_version string")
    found = {r["current_version"]: r["resolved_version"] for r in V.resolve_short(wants, history).collect()}
    assert found == {"v1.3.4": "v1.3.40/2024-02-01", "v1.3.40": "v1.3.40/2024-02-01", "v9.9.9": "v9.9.9"}


def test_update_is_any_difference(spark):
    history = _history(spark, ("a", "v1.0.0/2024-01-01", 1), ("b", "v2.0.0/2024-01-02", 2))
    rows = [(1, "c", "t", "v3.0.0/2025-01-01"), (2, "c", "t", "v2.0.0"), (3, "c", "t", "a"), (4, "c", "t", "zz"), (5, "c", "u", "v1.0.0/2024-01-01")]
    installed = spark.createDataFrame(rows, "row_id int, category string, name string, current_version string")
    out = {r["row_id"]: r for r in V.check_updates(installed, history).collect()}
    assert out[1]["update_available"] and not out[1]["breaking_changes"]
    assert not out[2]["update_available"]
    assert out[3]["breaking_changes"] and out[3]["migration_guide"].endswith("migration-from-v1x-to-v2x")
    assert out[4]["error"] == V.RESOLUTION_FAILED and out[5]["error"] == V.NOT_FOUND


def test_yaml_wins_listing_but_yml_wins_lookup(spark):
    listing = spark.createDataFrame(
        [("b", f"ns/templates/v2/storage/x.{e}", datetime(2024, 1, 1), 1) for e in ("yml", "yaml", "json")],
        "bucket string, key string, last_modified timestamp, size int",
    )
    assert C.list_catalog(listing, ["b"]).first()["extension"] == "yaml"
    wanted = spark.createDataFrame([(1, "storage", "x"), (2, "storage", "y")], "want_id int, category string, name string")
    found = {r["want_id"]: r["key"] for r in C.resolve_objects(wanted, listing, ["b"]).collect()}
    assert found == {1: "ns/templates/v2/storage/x.yml", 2: None}
    with pytest.raises(ValueError):
        C.allowed_sources(["other"], ["b"])
    assert C.allowed_sources(["other"], ["b"], strict=False) == []


def test_broken_sidecar_gives_defaults(spark):
    row = S.read_sidecars(spark.createDataFrame([("k", "{broken")], "key string, content string"), "plat").first()
    assert (row["deployment_platform"], row["repository_type"], row["has_cache_data"], row["topics"]) == ("plat", "app-starter", False, [])


def test_names(spark):
    schema = "name string, resource_type string, prefix string, project_id string, is_shared boolean, partial boolean"
    rows = [
        ("ACME-myapp-CodePipelineServiceRole", None, None, None, False, False),
        ("acme-app-Shared", "lambda", None, None, True, False),
        ("acme-app", "lambda", None, None, False, True),
        ("ac_me-app-test-Fn", "lambda", None, None, False, False),
        ("", None, None, None, False, False),
    ]
    out = {r["name"]: r for r in N.validate_names(spark.createDataFrame(rows, schema)).collect()}
    assert out["ACME-myapp-CodePipelineServiceRole"]["valid"]
    assert out["ACME-myapp-CodePipelineServiceRole"]["components"]["resource_suffix"] == "CodePipelineServiceRole"
    assert out["acme-app-Shared"]["valid"] and out["acme-app-Shared"]["components"]["stage_id"] is None
    assert out["acme-app"]["valid"]
    assert out["ac_me-app-test-Fn"]["errors"] == ["Prefix must contain only alphanumeric characters"]
    assert not out[""]["valid"] and out[""]["resource_type"] is None


def test_requests(spark):
    df = spark.createDataFrame([("get_template", '{"templateName": "x", "version": 5}'), ("list_tools", "null")], "tool string, input_json string")
    errors = {r["tool"]: r["errors"] for r in validate_requests(df).collect()}
    assert errors["get_template"] == ["Property 'version' must be of type string, got number"]
    assert errors["list_tools"] == ["Input must be an object"]


def test_settings():
    data = {"default": {"footer": "f"}, "prod": {"domain": "d"}}
    assert overlay_settings(data, "prod") == {"footer": "f", "domain": "d"}
    assert overlay_settings(data, "dev") == {"footer": "f"}


def test_tokens_inside_values(spark):
    pages = spark.createDataFrame([("p", "{{{settings.a}}}")], "path string, html string")
    row = apply_settings(pages, {"a": "<{{{settings.b}}}>", "b": "x"}).first()
    assert row["new_html"] == "<x>" and row["counts"] == {"a": 1, "b": 1}


def _skewed(spark):
    # One key holds most rows, and times repeat.
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, None).otherwise("cold").alias("k"),
        ((F.col("id") * 7919) % 500).alias("t"),
        "id",
        ((F.col("id") * 31) % 97 * 0.5).alias("v"),
    )


@pytest.fixture(params=["false", "true"])
def many_ranges(spark, request):
    """With and without the ranges of a sort merged into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbers_over_ranges_are_row_numbers(spark, many_ranges):
    df = _skewed(spark)
    for order in (["t", "id"], [F.col("t").desc(), "id"]):
        found = numbered(df, ["k"], order, "n").select("id", "n")
        plain = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint").alias("n"))
        assert found.exceptAll(plain).count() == 0 and found.count() == 3000


def test_a_burst_of_one_moment_is_split(spark, many_ranges):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.lit(5).alias("t"), "id")
    found = numbered(df, ["k"], ["t", "id"], "n")
    assert found.where("n <> id + 1").count() == 0 and found.count() == 4000
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false":
        from shelfmark.operators.ranking import _ranges

        assert _ranges(df, ["k", "t", "id"]).select("_range").distinct().count() == 4


def test_exact_quantiles(spark, many_ranges):
    df = _skewed(spark)
    found = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    values = df.toPandas().groupby("k", dropna=False)["v"]
    for key, group in values:
        key = None if key is None or key != key else key
        assert found[key]["p50"] == pytest.approx(np.quantile(group, 0.5))
        assert found[key]["p99"] == pytest.approx(np.quantile(group, 0.99))


def test_numbering_and_quantiles_read_their_rows_once(spark, tmp_path):
    _skewed(spark).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for made in (numbered(df, ["k"], ["t", "id"], "n"), exact_quantiles(df, ["k"], "v", {"p50": 0.5})):
        plan = made._jdf.queryExecution().toString()
        assert str(tmp_path) not in plan and "ResolvedHint" not in plan


def test_window_edges(spark):
    base = datetime(2024, 1, 1, 1, 0, tzinfo=timezone.utc)
    moments = [base, base + timedelta(milliseconds=1), base + timedelta(minutes=59, seconds=1)]
    df = spark.createDataFrame([("a", m, i) for i, m in enumerate(moments)], "client string, ts timestamp, request_id int")
    out = {r["request_id"]: r for r in rate_limited(df, 1, 60).collect()}
    end = int(base.timestamp())
    assert out[0]["reset_s"] == end and out[1]["reset_s"] == end + 3600 and out[2]["reset_s"] == end + 3600
    assert [out[i]["allowed"] for i in range(3)] == [True, True, False]
    assert out[2]["retry_after"] == 59
    assert rate_limited(df, 0, 60).where("allowed").count() == 2


def test_first_wins_is_idempotent(spark):
    once = first_wins(_skewed(spark), ["k"], ["t", "id"])
    assert once.exceptAll(first_wins(once, ["k"], ["t", "id"])).count() == 0 and once.count() == 3


def test_large_cuts_are_salted(spark):
    df = _skewed(spark)
    k = GROUP_LIMIT + 1
    plain = df.withColumn("_rank", F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))).where(F.col("_rank") <= k)
    assert top_k(df, ["k"], ["t", "id"], k).exceptAll(plain).count() == 0
    assert top_k(df, ["k"], ["t", "id"], k).count() == plain.count()


def test_unknown_templates_of_a_history_are_error_rows(spark):
    from shelfmark.operators.versions import history_errors

    versions = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "n")], "category string, name string")
    wanted = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), (None, "n"), ("b", None)], "category string, name string")
    found = {tuple(r) for r in history_errors(wanted, versions).collect()}
    code = "TEMPLATE_NOT_FOUND"
    assert found == {("a", "y", code, "Template not found: a/y"), (None, "n", code, "Template not found: /n"), ("b", None, code, "Template not found: b/")}
    assert history_errors(wanted.where("false"), versions).collect() == []


def test_a_search_makes_the_postings_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    postings = spark.range(300).select(
        F.lit("key").alias("keyword"), F.concat(F.lit("h"), F.col("id") % 100).alias("hash"), F.lit(3).alias("relevance_score")
    )
    postings = postings.mapInPandas(counted, postings.schema)
    meta = spark.range(100).select(
        F.concat(F.lit("h"), "id").alias("hash"), F.lit("t").alias("title"), F.lit("").alias("excerpt"), F.lit("p").alias("content_path"),
        F.lit("a").alias("type"), F.lit("").alias("sub_type"), F.lit("r").alias("repository"), F.lit("o").alias("owner"),
    )
    queries = spark.createDataFrame([(1, "key"), (2, "key other")], "query_id int, text string")
    found = ranked_search(queries, postings, meta, limit=5).collect()
    assert len(found) == 10 and {(r["relevance_score"], r["total_results"]) for r in found} == {(9, 100)}
    assert made.value == 300
