import random
import re

from pyspark.sql import functions as F

from shelfmark.operators.postings import postings


def _entry(spark, title, body, words):
    schema = "hash string, title string, content string, excerpt string, type string, keywords array<string>"
    return spark.createDataFrame([("h", title, body, body[:200], "documentation", words)], schema)


def _scores(title, body, words):
    title, body = title.lower(), body.lower()
    return {w.lower(): 10 * (w.lower() in title) + 5 * (w.lower() in body) + 3 for w in words}


def test_words_score_wherever_they_occur(spark):
    rng = random.Random(4)
    letters = ["".join(rng.choice("abc-9") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    for n in (0, 3, 40, 900):  # few words are looked up one by one, many by their lengths
        body = " ".join(letters[:n]) + " Tail.of_It"
        title = "A " + "".join(letters[n // 2 : n // 2 + 6])
        words = [*letters, *[w[1:-1] for w in letters if len(w) > 4], "tail.of", "l.o", "no where", "Tail", "zz"]
        found = {r["keyword"]: r["relevance_score"] for r in postings(_entry(spark, title, body, words)).collect()}
        assert found == _scores(title, body, words)


def test_odd_entries(spark):
    assert postings(_entry(spark, "", "", [])).collect() == []
    found = postings(_entry(spark, "", "", ["a"]).withColumn("title", F.lit(None).cast("string"))).collect()
    assert [(r["keyword"], r["relevance_score"], r["type_weight"]) for r in found] == [("a", 3, 1.0)]


def test_an_entry_of_many_words_takes_time_by_its_length(spark):
    words = [f"{k:x}-{k * 7919 % 100003:x}" for k in range(60_000)]
    inner = [w[1:] for w in words[::10]]
    found = postings(_entry(spark, " ".join(words[::50]), " ".join(words), words + inner))
    assert found.where("relevance_score >= 8").count() == len(set(words + inner))


def test_no_body_leaves_the_row_of_its_entry(spark):
    plan = postings(_entry(spark, "t", "b", ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    above, _, _ = plan.partition("Generate")
    assert "content" not in above and "body" not in above and "scored" in plan
    assert "Generate explode(scored" in plan


def test_each_text_is_cut_into_tokens_once(spark):
    plan = postings(_entry(spark, "t", "b", ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and "split(" not in plan


def test_words_of_title_body_both_and_neither(spark):
    words = ["Alpha", "beta", "gamma", "delta", "lph", "mm", "nowhere", "not here"]
    found = {r["keyword"]: r["relevance_score"] for r in postings(_entry(spark, "Alpha beta", "beta gamma", words)).collect()}
    assert found == _scores("Alpha beta", "beta gamma", words)
    assert found == {"alpha": 13, "beta": 18, "gamma": 8, "delta": 3, "lph": 13, "mm": 8, "nowhere": 3, "not here": 3}


def test_tokens_of_a_body_are_put_into_one_set(spark):
    plan = postings(_entry(spark, "t", "b", ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"array_intersect\(words#\d+, body_tokens", plan)
    assert not re.search(r"array_except\(\w+#\d+, (body|title)_tokens", plan)


def test_strays_are_counted_before_they_meet_the_entries(spark):
    from shelfmark.functions.text import path_hash
    from shelfmark.plans.index import consistency_checks

    schema = "content_path string, content string, excerpt string, keywords array<string>"
    entries = spark.createDataFrame([("a", "text", "text", ["w"])], schema).withColumn("hash", path_hash(F.col("content_path")))
    rows = spark.createDataFrame([("w", None), ("w", "gone"), ("v", "gone"), ("x", "lost")], "keyword string, hash string")
    made = entries.select(F.lit("w").alias("keyword"), "hash").unionByName(rows)
    checks = consistency_checks(entries, made)
    assert {r["check_name"]: r["violations"] for r in checks.collect()}["posting_without_entry"] == 4
    sound = consistency_checks(entries, made.where("hash NOT IN ('gone', 'lost')"))
    assert {r["violations"] for r in sound.collect()} == {0}
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    below = plan.partition("LeftAnti")[2]
    assert "Aggregate [hash" in below.partition("\n")[2].partition("Join")[0]


def test_first_entries_of_a_stored_table_are_marked_by_bits(spark):
    from shelfmark.operators.postings import first_rows, rows_marked, stored_unique_entries, unique_entries
    from shelfmark.session import stored

    rows = spark.range(70_000).select(
        F.when(F.col("id") % 1000 > 0, F.sha2((F.col("id") % 40_009).cast("string"), 256)).alias("hash"),
        (F.col("id") % 3).cast("int").alias("src_ord"), F.lit("r").alias("repository"),
        F.when(F.col("id") % 7 > 0, 70_000 - F.col("id")).alias("file_ord"), F.col("id").cast("int").alias("sec_ord"), F.lit("body").alias("content"),
    )
    wanted = sorted(r["sec_ord"] for r in unique_entries(rows).collect())
    for files in (1, 3):  # more rows than a part of a bitmap has
        found = stored_unique_entries(rows.coalesce(files))
        assert sorted(r["sec_ord"] for r in found.collect()) == wanted and found.columns == rows.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    empty = stored(rows.limit(0), "entries")
    assert rows_marked(empty, first_rows(empty)).collect() == []


def test_shuffle_files_go_when_a_table_is_stored(spark):
    import time

    from shelfmark.session import stored

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if "shuffle" in found.apply(k).getName()}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = spark.range(10_000).repartition(5, "id")
    assert kept.count() == 10_000
    own = files() - before
    table = stored(spark.range(10_000).repartition(7, "id"), "numbers")
    for _ in range(50):
        if not files() - before - own:
            break
        time.sleep(0.2)
    assert not files() - before - own and table.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
