import io
import os
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from shelfmark.operators import catalog as C
from shelfmark.operators import versions as V
from shelfmark.operators.logs import metric_series
from shelfmark.operators.rate_limit import rate_limited
from shelfmark.operators.sections import markdown_entries
from shelfmark.sources import index_store
from shelfmark.sources.archives import read_archives, read_tree
from shelfmark.sources.index_store import IndexStore
from shelfmark.streaming.metrics import MetricStream
from shelfmark.streaming.rate_limit import RateLimitStream

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("root/", "")
        archive.writestr("root/README.md", "# Hi")
        archive.writestr("root/src/a.bin", b"\xff")
    (tmp_path / "good.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = read_archives(spark, str(tmp_path)).collect()
    assert {r["path"]: r["content"] for r in rows if r["error"] is None} == {"README.md": "# Hi", "src/a.bin": chr(0xFFFD)}
    assert sum(r["error"] is not None for r in rows) == 1


def test_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.html").write_text("<p>\n</p>")
    (tmp_path / "a" / "y.json").write_text("{}")
    (tmp_path / "z.css").write_text("")
    assert {r["path"]: r["html"] for r in read_tree(spark, str(tmp_path)).collect()} == {"a/b/x.html": "<p>\n</p>", "a/y.json": "{}"}


def test_trees_are_written_as_files(spark, tmp_path):
    from shelfmark.sources.trees import write_tree

    root = tmp_path / "site"
    (root / "kept").mkdir(parents=True)
    (root / "kept" / "old.html").write_text("old")
    pages = [("index.html", "<p>é\n</p>"), ("a/b/x.html", ""), ("kept/new.html", None)]
    write_tree(spark.createDataFrame(pages, "path string, html string").repartition(3), str(root))
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {
        "index.html": "<p>é\n</p>", "a/b/x.html": "", "kept/new.html": "", "kept/old.html": "old"
    }
    for bad in ("../out.html", "/etc/x", "a/../../x", "", "dir/"):  # a failing page leaves the tree as it was
        rows = spark.createDataFrame([("fresh.html", "x"), (bad, "x")], "path string, html string").coalesce(1)
        with pytest.raises(Exception, match="not a path inside a tree"):
            write_tree(rows, str(root))
        assert sorted(p.name for p in root.iterdir()) == ["a", "index.html", "kept"]


def test_index_versions(spark, tmp_path):
    files = spark.createDataFrame(
        [("o", "r", 0, 1, "README.md", "# Install\nRun it"), ("o", "r", 0, 2, "a.py", 'def f():\n    """Doc."""')],
        "owner string, repo string, src_ord int, file_ord bigint, path string, content string",
    )
    store = IndexStore(spark, str(tmp_path / "index"))
    day = datetime(2025, 7, 14, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        store.read("postings", day)
    first = store.build(files, day)
    with pytest.raises(ValueError):
        store.rollback(day)
    second = store.build(files.where("file_ord = 1"), day + timedelta(days=1), publish=False)
    assert store.pointer()[1] == first
    store.publish(second, day + timedelta(days=1))
    assert store.pointer()[1:] == (second, first)
    assert store.read("entry_meta", day).count() == 1 and store.main_index(day, first).count() == 2
    # A repeated build replaces its own version.
    assert store.build(files, day, publish=False) == first and store.main_index(day, first).count() == 2
    assert store.rollback(day + timedelta(days=2)) == first
    late = day + timedelta(days=9)
    assert store.expire(late) == [second]
    with pytest.raises(ValueError):
        store.publish(second, late)
    assert store.read("entry_meta", late).count() == 0


def test_a_build_makes_its_postings_once(spark, tmp_path, monkeypatch):
    made, scored = spark.sparkContext.accumulator(0), index_store.postings

    def counted(entries):
        rows = scored(entries)

        def seen(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(seen, rows.schema)

    monkeypatch.setattr(index_store, "postings", counted)
    texts = [("o", "r", 0, k, f"{k}.md", f"# Title {k}\nfirst second third{k}") for k in range(50)]
    files = spark.createDataFrame(texts, "owner string, repo string, src_ord int, file_ord bigint, path string, content string")
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(files, datetime(2025, 7, 14, tzinfo=timezone.utc))
    rows = store.read("postings", datetime(2025, 7, 14, tzinfo=timezone.utc)).count()
    assert rows > 100 and made.value == rows
    assert not any((tmp_path / "index" / "scored").iterdir())


def test_stream_of_batches_equals_batch(spark, tmp_path):
    schema = "client string, ts timestamp, request_id bigint"
    requests = spark.range(400).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("client"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40).alias("ts"),
        F.col("id").alias("request_id"),
    )
    source = tmp_path / "in"
    for i in range(4):
        part = requests.where(F.floor(F.col("request_id") / 100) == i).coalesce(1)
        part.write.mode("append").parquet(str(source))
    stream = RateLimitStream(str(tmp_path / "out"), 5, 60)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream.start(arriving, str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["request_id", "nth", "allowed", "remaining", "retry_after"]
    streamed = stream.verdicts(spark).select(*columns)
    batch = rate_limited(requests, 5, 60).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == 400
    # A batch that is run again gives the same output.
    again = requests.where("request_id >= 100 AND request_id < 200")
    stream.process(again, 1)
    assert stream.verdicts(spark).select(*columns).exceptAll(batch).count() == 0


def test_late_requests_get_no_new_allowance(spark, tmp_path):
    batches = [[("a", 10)], [("b", 180)], [("a", 20), ("b", 181)], [("c", 400)], [("a", 30), ("c", 401)], [], [("a", 31), ("b", 150)]]
    stream, number = RateLimitStream(str(tmp_path / "out"), 1, 60), 0
    for batch_id, batch in enumerate(batches):
        rows = [(client, minute, number + k) for k, (client, minute) in enumerate(batch)]
        number += len(rows)
        df = spark.createDataFrame(rows, "client string, minute int, request_id bigint")
        stream.process(df.withColumn("ts", F.timestamp_seconds(F.lit(1_699_999_200) + F.col("minute") * 60)), batch_id)
    found = {r["request_id"]: (r["client"], r["nth"], r["allowed"]) for r in stream.verdicts(spark).collect()}
    assert [found[k] for k in range(number)] == [
        ("a", 1, True), ("b", 1, True), ("a", 2, False), ("b", 1, True), ("c", 1, True), ("a", 3, False), ("c", 2, False),
        ("a", 4, False), ("b", 2, False),
    ]


def test_late_samples_count(spark, tmp_path):
    samples = spark.range(300).select(
        F.concat(F.lit("m"), F.col("id") % 2).alias("metric"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"),
        (F.col("id") * 7 % 5).alias("part"),
    )
    stream, source = MetricStream(str(tmp_path / "out"), 3600), str(tmp_path / "in")
    for part in (4, 1, 0, 3, 2):
        samples.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        arriving = spark.readStream.schema("metric string, ts timestamp, value double").parquet(source)
        stream.start(arriving, str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["metric", "period", "samples", "sum_value", "avg_value", "max_value", "min_value"]
    batch = metric_series(samples, 3600, p99=False).select(*columns)
    streamed = stream.series(spark).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()


def test_samples_behind_all_others_count(spark, tmp_path):
    stream, source = MetricStream(str(tmp_path / "out"), 3600), str(tmp_path / "in")
    for second in (1_700_000_000, 1_700_086_400, 1_700_000_060, 1_700_172_800, 1_700_000_120):
        row = spark.createDataFrame([("m", second)], "metric string, second bigint")
        row = row.select("metric", F.timestamp_seconds("second").alias("ts"), F.lit(1.0).alias("value"))
        row.write.mode("append").parquet(source)
        arriving = spark.readStream.schema("metric string, ts timestamp, value double").parquet(source)
        stream.start(arriving, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["samples"] for r in stream.series(spark).collect()) == [1, 1, 3]


@needs_data
def test_first_wins_limits_before_the_shuffle(spark):
    from workload import adapters as A
    from workload.registry import Tables

    t = Tables(spark, DATA)
    for df in (C.list_catalog(A.objects(t), A.SOURCES), V.current_versions(A.object_versions(t))):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    native = plan(markdown_entries(A.files_md(t)))
    assert "Python" not in native and "Arrow" not in native


@needs_data
def test_no_cartesian_products(spark):
    names = ["ranked_search_cut_first", "check_updates", "point_lookup", "starters_with_sidecars", "rate_limit", "latency_by_tool"]
    for name in names:
        text = plan(entry_module.queries()[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@needs_data
def test_columns_and_filters_reach_the_scan(spark):
    text = plan(entry_module.queries()["alarm_error_sum"](spark, DATA))
    assert "EqualTo(event_type,error)" in text and "props" not in text


@needs_data
def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    # Greedy packing has no practical SQL; its invariants are checked instead.
    from workload import QUERIES

    assert set(QUERIES) <= set(oracles)
    assert set(QUERIES) <= set(queries)


@needs_data
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def _files(spark, *bodies):
    rows = [("o", "r", 0, k, f"docs/{k}.md", f"# Title {k}\n{body}") for k, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "owner string, repo string, src_ord int, file_ord bigint, path string, content string")


def test_a_failed_rebuild_leaves_the_version_as_it_was(spark, tmp_path, monkeypatch):
    from datetime import datetime, timezone

    from shelfmark.sources import index_store

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = index_store.IndexStore(spark, str(tmp_path / "index"))
    version = store.build(_files(spark, "alpha words"), now)

    def broken(*_args, **_more):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(index_store, "postings", broken)
        with pytest.raises(RuntimeError):
            store.build(_files(spark, "beta words"), now)
    assert [r["title"] for r in store.read("entry_meta", now).collect()] == ["Title 0"]
    assert {r["keyword"] for r in store.read("postings", now).collect()} >= {"alpha"}
    assert "beta" not in {k for r in store.read("entry_meta", now).collect() for k in r["keywords"]}
    assert len(store.clean_up()) == 1 and store.clean_up() == []
    # a second build of the same version replaces it as a whole
    assert store.build(_files(spark, "beta words"), now) == version
    assert "alpha" not in {r["keyword"] for r in store.read("postings", now).collect()}
    assert store.versions() == [version]


def test_one_of_two_moves_of_the_pointer_fails(spark, tmp_path):
    from datetime import datetime, timezone

    from shelfmark.sources.index_store import IndexStore

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(_files(spark, "alpha"), now, version="a")
    sequence, active, _ = store.pointer()
    with pytest.raises(RuntimeError):
        store._move(sequence, "b", active, now)
    assert store.pointer()[:2] == (sequence, "a")


def test_null_values_are_not_absent_rows(spark):
    from shelfmark.operators.catalog import changed_items
    from shelfmark.operators.site import sync_plan

    pages = spark.createDataFrame([("same", None), ("new", None)], "path string, html string")
    old = spark.createDataFrame([("same", None), ("gone", None)], "path string, html string")
    assert {tuple(r) for r in sync_plan(pages, old).collect()} == {("new", "add"), ("gone", "delete")}
    before = spark.createDataFrame([("k", "same", None), ("k", "set", None), ("k", "gone", None)], "key string, item string, value string")
    after = spark.createDataFrame([("k", "same", None), ("k", "set", "1"), ("k", "new", None)], "key string, item string, value string")
    found = {(r["item"], r["change"]) for r in changed_items(before, after, ["key"], "item", "value").collect()}
    assert found == {("set", "changed"), ("gone", "removed"), ("new", "added")}


def test_the_package_is_shipped_to_workers(spark):
    from shelfmark.session import ship

    ship(spark)
    files = spark.sparkContext._jsc.sc().listFiles().mkString(",")
    assert "shelfmark.zip" in files


def test_a_search_reads_the_buckets_of_its_terms_and_hits(spark, tmp_path):
    from shelfmark.operators.search import ranked_search, search_scores
    from shelfmark.sources.index_store import IndexStore

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = IndexStore(spark, str(tmp_path / "index"), buckets=32)
    store.build(_files(spark, *[f"alpha word{k} term{k * 7}" for k in range(200)]), now)
    queries = spark.createDataFrame([(1, "word17 the"), (2, "term21 nothing"), (3, "")], "query_id int, text string")
    found = store.search(queries, now)
    tables = [store.read(name, now) for name in ("postings", "entry_meta")]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ranked_search(queries, *tables).collect()))
    assert found.count() == 2

    def partitions(df):
        """Partitions of the stored index that a job has read: those of its last table."""
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
        counts = []
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            while "QueryStage" in leaf.nodeName():
                leaf = leaf.plan()
            if leaf.metrics().contains("numPartitions"):
                counts.append(leaf.metrics().apply("numPartitions").value())
        return counts

    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert all(n <= 2 for n in partitions(found)) and partitions(found)
    scores = search_scores(queries, store._live("postings", store._attempt(store.pointer()[1])[0], now), 32)
    assert "dynamicpruning" in scores._jdf.queryExecution().toString()


def test_a_move_that_was_never_finished_is_none(spark, tmp_path):
    from shelfmark.sources.index_store import IndexStore

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(_files(spark, "alpha"), now, version="a")
    (tmp_path / "index" / "pointer" / "move-000000000002.json").write_text('{"seq": 2, "ver')
    assert store.pointer()[:2] == (1, "a")
    store.build(_files(spark, "beta"), now, version="b")
    assert store.pointer() == (3, "b", "a")


def test_damaged_files_become_error_rows(spark, tmp_path):
    from shelfmark.sources.landing import land_sources

    rows = spark.range(4000).selectExpr("id", "cast(id * 7919 % 1000 as string) AS word")
    for name in ("good", "hurt"):
        rows.repartition(4).write.parquet(str(tmp_path / name))
    cut, empty = sorted((tmp_path / "hurt").glob("*.parquet"))[:2]
    data = cut.read_bytes()
    cut.write_bytes(data[: len(data) // 2])
    (tmp_path / "hurt" / f".{cut.name}.crc").unlink()
    lost = 4000 - spark.read.option("ignoreCorruptFiles", "true").schema("id long").parquet(str(tmp_path / "hurt")).count()
    spark.range(0).selectExpr("id", "'' AS word").coalesce(1).write.parquet(str(tmp_path / "none"))
    folders = {n: str(tmp_path / n) for n in ("good", "hurt", "none", "away")}
    found, errors, partial = land_sources(spark, folders, "id long, word string")
    assert partial and {r["source"]: r["count"] for r in found.groupBy("source").count().collect()} == {"good": 4000, "hurt": 4000 - lost}
    assert {(r["source"], (r["path"] or "").split("/")[-1]) for r in errors.collect()} == {("hurt", cut.name), ("away", "")}
    assert not land_sources(spark, {n: folders[n] for n in ("good", "none")}, "id long, word string")[2]
    assert land_sources(spark, {"away": folders["away"]}, "id long, word string")[0].collect() == []


def test_checks_of_a_build_see_what_is_wrong(spark, tmp_path):
    from shelfmark.plans.index import build_checks
    from shelfmark.sources.index_store import IndexStore

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(_files(spark, "alpha beta", "gamma"), now)
    assert {r["violations"] for r in store.checks(now).collect()} == {0} and store.checks(now).count() == 7
    one = spark.createDataFrame([("a", 1), ("a", 1)], "version string, expires_at int")
    two = spark.createDataFrame([("b", None), ("a", 2)], "version string, expires_at int")
    found = {r["check_name"]: r["violations"] for r in build_checks({"one": one, "two": two}).collect()}
    assert found == {"one_version": 1, "one_expires_at": 2}
    # a posting whose entry is gone
    stray = spark.createDataFrame([("word", "nothing", 3, 1.0, now)], "keyword string, hash string, relevance_score int, type_weight double, expires_at timestamp")
    attempt, _ = store._attempt(store.pointer()[1])
    stray.write.mode("append").parquet(store._path("postings", attempt) + "/bucket=0")
    found = {r["check_name"]: r["violations"] for r in store.checks(now).collect()}
    assert found["posting_without_entry"] == 1 and found["bad_hash"] == 0


def test_postings_name_their_entry_by_a_number_in_the_order_of_hashes(spark, tmp_path, monkeypatch):
    from shelfmark.sources import index_store
    from shelfmark.sources.index_store import IndexStore, entry_number

    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(_files(spark, *[f"alpha beta{k}" for k in range(40)]), now)
    attempt, _ = store._attempt(store.pointer()[1])
    laid_out = spark.read.parquet(store._path("postings", attempt))
    assert "entry" in laid_out.columns and "hash" not in laid_out.columns
    # what is read has the hashes of the entries again
    meta = store.read("entry_meta", now)
    wanted = {(w, r["hash"]) for r in meta.collect() for w in r["keywords"]}
    assert {(r["keyword"], r["hash"]) for r in store.read("postings", now).collect()} == wanted
    hashes = spark.createDataFrame([(x * 16 + "0" * 48,) for x in "0789af"] + [("f" * 15 + "e" + "0" * 48,)], "hash string")
    numbers = hashes.select("hash", entry_number(hashes["hash"]).alias("n")).collect()
    assert [r["hash"] for r in sorted(numbers, key=lambda r: r["n"])] == sorted(r["hash"] for r in numbers)
    # steps that later ones do not read are dropped
    assert not any((tmp_path / "index" / "code_items").iterdir()) and not (tmp_path / "index" / "entries").exists()
    monkeypatch.setattr(index_store, "entry_number", lambda hash_: (F.crc32(hash_) % 3).cast("bigint"))
    with pytest.raises(RuntimeError, match="64 bits"):
        store.build(_files(spark, *["alpha"] * 9), now)
