import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from shelfmark.llm import grid_order_join, paragraph_minhash, vantage_simhash
from shelfmark.llm.base import text_bytes
from shelfmark.llm.components import Forest, components


def roots(n, linked, names=None):
    forest = Forest()
    for i in range(n):
        for j in linked(i):
            forest.join(i, j)
    return [forest.root(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)]
    links += [(7, k) for k in range(2000, 2100)] + [(5, 5), (5, 5)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: forest.root(x) for x in nodes}
    assert components(df.where("false")).collect() == []


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), seed=42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "A", "É a", "x Y z", "the THE the the the", "a b\tc d É\x1cf\n" * 50])
def test_fingerprints(text):
    assert vantage_simhash.fingerprint(text) == slow_fingerprint(text)


def test_the_xxhash_of_spark_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a bé c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a bé c d".encode(), seed=42)


def flipped(rng, value, bits):
    for b in rng.choice(64, bits, replace=False):
        value ^= np.uint64(1 << int(b))
    return value


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("few", [16, 1024])
def test_trees_find_all_links(monkeypatch, dense, few):
    monkeypatch.setattr(vantage_simhash, "FEW", few)
    monkeypatch.setattr(vantage_simhash, "SIDE", 64)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for k in range(500, 2000 if dense else 1000):
        points[k] = flipped(rng, points[0 if dense else k - 500], int(rng.integers(1, 7)))
    points = np.unique(points)
    near = lambda i: np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist()
    want = roots(len(points), near)
    forest = Forest()
    for a, b in vantage_simhash.linked(points, np.ones(len(points), bool)):
        forest.join(a, b)
    assert [forest.root(i) for i in range(len(points))] == want
    tree, leaves = vantage_simhash.build(points, len(points), 4, 100)
    leaf, index, home = vantage_simhash.routed(tree, points)
    assert leaves > 5 and sorted(index[home].tolist()) == list(range(len(points)))  # one home each
    forest = Forest()
    for k in range(leaves):
        at, own = index[leaf == k], home[leaf == k]
        for a, b in vantage_simhash.linked(points[at], own) if own.any() else []:
            forest.join(int(at[a]), int(at[b]))
    assert [forest.root(i) for i in range(len(points))] == want


def test_links_at_the_sizes_in_use():
    """Enough fingerprints that the shared tree splits them, with the constants as they are."""
    rng = np.random.default_rng(9)
    points = rng.integers(0, 2**63, 140_000, dtype=np.uint64)
    planted = [(k, 70_000 + k) for k in range(3000)]
    for a, b in planted:
        points[b] = flipped(rng, points[a], int(rng.integers(1, 5)))
    sample = np.sort(points[:: len(points) // vantage_simhash.SAMPLE])
    tree, leaves = vantage_simhash.build(sample, len(points))
    leaf, index, home = vantage_simhash.routed(tree, points)
    assert leaves > 1 and len(index) < 4 * len(points)
    forest = Forest()
    for k in range(leaves):
        at, own = index[leaf == k], home[leaf == k]
        for a, b in vantage_simhash.linked(points[at], own) if own.any() else []:
            forest.join(int(at[a]), int(at[b]))
    assert all(forest.root(a) == forest.root(b) for a, b in planted)
    for a, b in forest.stars()[:500]:  # and nothing but chains of links
        near = np.bitwise_count(points ^ points[a]) <= 4
        assert near.sum() > 1


@pytest.mark.parametrize("sizes", [(20_000, 65_536, 262_144), (100, 20, 1000), (100, 20, 10)])
def test_simhash_groups(tables, monkeypatch, sizes):
    for name, value in zip(("SAMPLE", "LEAF", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(vantage_simhash, name, value)
    docs = tables("documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = np.array([slow_fingerprint(r["text"]) for r in rows], np.uint64)
    root = roots(len(rows), lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist())
    want = {(r["doc_id"], f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, root, strict=True)}
    assert {tuple(r) for r in vantage_simhash.near_duplicates(docs).collect()} == want
    kept = [r["doc_id"] for r in vantage_simhash.without_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = vantage_simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in empty} == {0} and {r["doc_id"] for r in empty} == {0, 1, 2, None}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = vantage_simhash.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({r["component_id"] for r in rows})
    assert vantage_simhash.near_duplicates(no_docs).collect() == []


def slow_units(text):
    """Units of a text as (place, start, end, words): around the first least shingle of every window."""
    pm = paragraph_minhash
    spans = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text or "")]
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    words = [small[a:b] for a, b in spans]
    # the hashes are the operator's own, all else is done again
    batch = pm._Cut(*text_bytes(pa.array([" ".join(words)])))
    fit = range(pm.BEFORE, len(words) - (pm.UNIT - pm.BEFORE) + 1)
    if not fit:
        return []
    with np.errstate(over="ignore"):
        key = dict(zip(fit, (batch._sums(np.array(fit), pm.SHINGLE) >> np.uint64(20)).tolist(), strict=True))
    windows = [fit[k : k + pm.WINDOW] for k in range(max(1, len(fit) - pm.WINDOW + 1))]
    anchors = sorted({min(w, key=lambda at: (key[at], at)) for w in windows})
    at = [a - pm.BEFORE for a in anchors]
    return [(a, spans[a][0], spans[a + pm.UNIT - 1][1], words[a : a + pm.UNIT], words[a + pm.BEFORE :][:5]) for a in at]


def slow_groups(docs):
    """Groups of units with one anchor and a similarity of 0.8."""
    found = [(d, u) for d, text in docs for u in slow_units(text)]
    sets = [paragraph_minhash.shingles(u[3]) for _, u in found]

    def near(i):
        return [j for j in range(i) if found[i][1][4] == found[j][1][4] and paragraph_minhash.jaccard(sets[i], sets[j]) >= 0.8]

    # equal units are one class whatever their anchors
    same = {}
    whole = lambda i: [same.setdefault(tuple(found[i][1][3]), i)]
    groups = {}
    for (d, u), root in zip(found, roots(len(found), lambda i: near(i) + whole(i)), strict=True):
        groups.setdefault(root, []).append((d, u[0]))
    return sorted(sorted(g, key=str) for g in groups.values() if len(g) > 1)


def found_groups(docs):
    groups = {}
    rows = paragraph_minhash.repeated_paragraphs(docs).collect()
    for r in rows:
        groups.setdefault((r["keeper_row"], r["keeper_place"]), []).append((r["doc_id"], r["place"]))
    assert sum(r["kept"] for r in rows) == len(groups)
    return sorted(sorted(g, key=str) for g in groups.values())


def sentence(rnd, n, ends=" "):
    words = [f"w{k}" for k in range(400)] + ["É", "Über", "ÀÇ×", "x" * 80, "漢字"]
    return "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(n))


@pytest.mark.parametrize("size", [1, 50, 300, 5000, 1 << 22])
def test_units_of_texts_cut_anywhere(monkeypatch, size):
    monkeypatch.setattr(paragraph_minhash, "BATCH", size)
    rnd = random.Random(1)
    ends = [" ", "\n", " \t ", "\r\n"]
    texts = ["", None, "a b", "q " * 400, *[sentence(rnd, n, ends) for n in (19, 20, 21, 50, 51, 52, 60, 3000)], "  " + sentence(rnd, 51)]
    found = [x for c in paragraph_minhash._units(*text_bytes(pa.array(texts)), True) for x in zip(*(list(y) for y in c), strict=True)]
    want = [(k, a, s, e, " ".join(w)) for k, text in enumerate(texts) for a, s, e, w, _ in slow_units(text)]
    assert sorted((int(x[0]), int(x[1]), int(x[2]), int(x[3]), x[6].decode()) for x in found) == sorted(want)


def test_every_copy_of_51_words_shares_a_unit():
    """Inside long lines, in wrapped lines and at the ends of texts, whatever stands around."""
    rnd = random.Random(2)
    for _ in range(200):
        words = sentence(rnd, 51).split()
        texts = []
        for ends in (" ", "\n"):
            passage = "".join(w + (ends if k % 12 == 11 else " ") for k, w in enumerate(words))
            texts.append(sentence(rnd, rnd.randint(0, 90)) + passage + sentence(rnd, rnd.randint(0, 90)))
        one, two = ({tuple(u[3]) for u in slow_units(t)} for t in texts)
        assert one & two


def test_units_near_a_common_one(spark, monkeypatch):
    """One passage and variants of it, many of which are near the common one only, or only near each other."""
    monkeypatch.setattr(paragraph_minhash, "BLOCK", 6)
    rnd, docs = random.Random(3), []
    words = [f"w{k}" for k in range(300)]
    for _ in range(3):
        base = [rnd.choice(words) for _ in range(24)]
        for changes in [0, 0, *[rnd.choice([1, 1, 2, 3]) for _ in range(20)]]:
            own = list(base)
            for _ in range(changes):
                own[rnd.choice([0, 1, 2, 3, 4, 18, 19, 20, 21, 22, 23])] = rnd.choice(words[:3])
            docs.append((len(docs), "short\n" + " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    want = slow_groups(docs)
    assert found_groups(df) == want and any(len(g) > 6 for g in want)


def test_units_of_few_words(spark):
    """Texts in which runs of words repeat, so that similar units may differ in their inner words."""
    rnd, docs = random.Random(12), []
    for _ in range(60):
        base = [rnd.choice("abc") for _ in range(rnd.choice([20, 20, 21, 26]))]
        for _ in range(5):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice("abcd")
            docs.append((len(docs), " ".join(own)))
    cut = [list(x) for c in paragraph_minhash._units(*text_bytes(pa.array([t for _, t in docs])), False) for x in [c[-1]]]
    cores = np.concatenate(cut)
    assert (cores == 0).any() and (cores != 0).any()
    want = slow_groups(docs)
    assert found_groups(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)) == want and len(want) > 40


def test_common_words_alone_share_no_band(spark):
    """Texts that have five words in common, which are an anchor in all of them, and nothing else."""
    rnd = random.Random(13)
    least = min((f"k{k}" for k in range(3000)), key=lambda w: paragraph_minhash._Cut(
        *text_bytes(pa.array([f"{w} " * 7 + f"{w} b c d e" + " x" * 8]))).key.view(np.uint64)[0])
    own = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    texts = [f"{own(7)} {least} b c d e {own(8)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").coalesce(2)
    assert paragraph_minhash.units(docs).select("key").distinct().count() == 1
    assert paragraph_minhash.shared_bands(docs).count() == 1
    assert found_groups(docs) == [[(0, 0), (300, 0)]]
    # so many units are similar by less than 14/18 that five common words must do
    assert paragraph_minhash.shared_bands(docs, 0.7).count() == 1 and not paragraph_minhash._by_core(0.7)


def test_changed_passages_are_found(spark):
    """Passages of 100 words of which one copy has a word changed, inside long lines."""
    rnd, docs = random.Random(6), []
    for k in range(200):
        passage = sentence(rnd, 100).split()
        changed = list(passage)
        changed[rnd.randrange(100)] = "changed"
        for n, words in enumerate((passage, changed)):
            docs.append((2 * k + n, sentence(rnd, rnd.randint(5, 60)) + " ".join(words) + " " + sentence(rnd, rnd.randint(5, 60))))
    docs += [(1000 + k, sentence(rnd, 200)) for k in range(100)]
    rows = paragraph_minhash.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} <= set(range(1, 400, 2))
    assert len({r["doc_id"] for r in rows if not r["kept"]}) >= 195
    cut = {d: 0 for d in range(400)}
    for r in rows:
        cut[r["doc_id"]] += 0 if r["kept"] else r["words"]
    assert np.mean([cut[d] for d in range(1, 400, 2)]) > 60


def test_units_of_odd_rows(odd_docs, no_docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert sum(map(len, found_groups(odd_docs))) == sum(map(len, slow_groups(rows)))
    left = paragraph_minhash.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    line = " ".join(f"term{k}" for k in range(40))
    texts = [r["text"] for r in left.collect()]
    assert sum(line in (t or "") for t in texts) == 1 and "a" in texts and texts.count(None) == 2
    for empty in (no_docs, spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string").coalesce(1)):
        assert paragraph_minhash.repeated_passages(empty).collect() == []
        assert paragraph_minhash.without_repeats(empty).count() == empty.count()
    alone = spark.createDataFrame([(None, line, 1), (None, line, 2)], "doc_id long, text string, place int").coalesce(1)
    assert [r["kept"] for r in paragraph_minhash.repeated_passages(alone).orderBy("row").collect()] == [True, False]


def test_cut_passages_leave_the_rest(spark, tmp_path):
    rnd = random.Random(8)
    passage = sentence(rnd, 120).strip()
    rows = [(1, f"{passage}\nown one", 0), (2, f"é a\n{passage}\nb\n", 0), (3, passage, 0), (4, "kept as it is\n", 14), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in paragraph_minhash.without_repeats(docs).collect()}
    cuts = {r["doc_id"]: r for r in paragraph_minhash.repeated_passages(docs).where("not kept").collect()}
    assert set(cuts) == {2, 3} and left[1] == rows[0][1:] and left[4] == rows[3][1:] and left[5] == (None, None)
    for doc_id in (2, 3):
        text, cut = rows[doc_id - 1][1], cuts[doc_id]
        want = text[: cut["start"]] + text[cut["end"] :]
        assert left[doc_id] == (want, len(want)) and cut["words"] >= 70


def test_grid_order_join(tables, spark, monkeypatch):
    for name, value in (("RUN", 40), ("BLOCK", 8), ("SAMPLE", 100)):
        monkeypatch.setattr(grid_order_join, name, value)
    nan, inf, ones = float("nan"), float("inf"), [1.0] * 64
    odd = [
        (None, 1), ([0.0] * 64, 1), ([nan, *ones[1:]], 2), ([None, *ones[1:]], 2), ([inf, *ones[1:]], 2), (ones, None), (ones, None),
        ([2.0] * 64, 3), (ones, 3), (ones, 3), ([1.0] * 8, 3), ([1.0] * 8, 3), ([-0.0, *ones[1:]], 4), ([0.0, *ones[1:]], 4), ([], 4),
    ]
    extra = spark.createDataFrame([(10_000 + k, e, label) for k, (e, label) in enumerate(odd)], "vec_id long, embedding array<float>, label int")
    rng = np.random.default_rng(2)
    made = []
    for k in range(240):
        base = rng.normal(size=16) if k % 6 == 0 else base
        made.append((20_000 + k, [float(v) for v in base + rng.normal(size=16) * 0.09 * (k % 6)], k % 2))
    extra = extra.unionByName(spark.createDataFrame(made, extra.schema))
    vectors = tables("embeddings").select("vec_id", "embedding", "label").unionByName(extra)
    rows = vectors.collect()

    def usable(r):
        e = r["embedding"]
        return bool(e) and r["label"] is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)

    forest, links, groups = Forest(), dict.fromkeys([r["vec_id"] for r in rows], 0), {}
    for r in filter(usable, rows):
        groups.setdefault((r["label"], len(r["embedding"])), []).append((r["vec_id"], np.array(r["embedding"], float)))
    for group in groups.values():
        x = np.array([v / np.linalg.norm(v) for _, v in group])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
            a, b = group[i][0], group[j][0]
            links[a] += 1
            links[b] += 1
            forest.join(a, b)
    want = {(v, n, forest.root(v), forest.root(v) == v) for v, n in links.items()}
    assert {tuple(r) for r in grid_order_join.near_duplicates(vectors).collect()} == want
    assert grid_order_join.near_duplicates(vectors.where("false")).collect() == []
