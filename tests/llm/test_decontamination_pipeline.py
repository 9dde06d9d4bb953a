import random

import numpy as np
import pytest

from shelfmark.llm import latent_decontam


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(k, 14))] for k in (1, 0))
        assert latent_decontam.subsequence(latent_decontam.masks_of(a), len(a), b) == common(a, b)


def test_the_answer_is_the_last_sentence():
    item = latent_decontam.item_of(1, "Who wrote it? Nobody knows. The third man did.\nOh.")
    assert item.answer == (b"the", b"third", b"man", b"did")
    assert latent_decontam.item_of(1, "two words").answer == (b"two", b"words")


def plain(text):
    return b" " + b" ".join(latent_decontam.words_of(text)) + b" "


def test_exact_passages_and_paraphrases(tables, spark):
    docs, items = tables("documents").select("doc_id", "text"), tables("benchmark")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    wanted = {r["item_id"]: r["text"] for r in items.collect()}
    exact = {(d, i) for d, t in texts.items() for i, w in wanted.items() if plain(w) in plain(t)}
    rnd, planted = random.Random(5), []
    clean = [t for d, t in texts.items() if t and len(t) > 1500 and not any(d == x for x, _ in exact)]
    for k, text in enumerate(clean[:20]):
        item = sorted(wanted)[k % len(wanted)]
        words = [w for w in latent_decontam.words_of(wanted[item]) if rnd.random() > 0.08]
        split = text.split(" ")
        at = rnd.randrange(len(split))
        planted.append((10_000 + k, " ".join([*split[:at], *[w.decode().upper() for w in words], *split[at:]]), item))
    more = spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in latent_decontam.contaminated(docs.unionByName(more), items).collect()}
    assert exact <= found
    hits = sum((d, i) in found for d, _, i in planted)
    assert hits >= 0.9 * len(planted)
    assert len({d for d, _ in found if d < 10_000} - {d for d, _ in exact}) <= 1


def test_parts_with_too_few_words_have_no_cosine(monkeypatch):
    """No latent vector is made where the words of a part cannot make a leak; where they can, the leak is found."""
    words = latent_decontam.words_of("a b c d e f g h i j")
    vocabulary = {w: k for k, w in enumerate(words)}
    space = np.eye(len(words), dtype=np.float32)
    known = latent_decontam.Words(vocabulary, np.ones(len(words), np.int64), np.ones(len(words)), space)
    model = latent_decontam.model_of(known, [(1, "a b c d e f g h i j")])
    item = model.items[0]
    prepared = [(latent_decontam.masks_of(words), latent_decontam.masks_of(list(item.answer)), latent_decontam.Counter(words))]
    calls, near = [], latent_decontam.Model.near
    monkeypatch.setattr(latent_decontam.Model, "near", lambda *args: calls.append(args[1:]) or near(*args))
    few = latent_decontam.words_of("z a b a b a b a b a b z")  # ten places, but two words
    assert model.possible(model.terms(few)) and model.matches(few, prepared, latent_decontam.COSINE) == [] and not calls
    enough = latent_decontam.words_of("z a b c d e q f g h i j z")
    assert [m["item_id"] for m in model.matches(enough, prepared, latent_decontam.COSINE)] == [1] and len(calls) == 1


def leaks_by_force(words, item):
    """Length of the best leak of an item, comparing the stretch at every word."""
    size, found = len(item.words), 0
    masks, answer = latent_decontam.masks_of(list(item.words)), latent_decontam.masks_of(list(item.answer))
    for at in range(len(words)):
        part = words[at : at + size + size // 2 + 2]
        length = latent_decontam.subsequence(masks, size, part)
        answered = latent_decontam.subsequence(answer, len(item.answer), part) >= 0.8 * len(item.answer)
        if length / size >= 0.75 or length / size >= 0.6 and answered:
            found = max(found, length)
    return found


def test_every_leak_is_found_whatever_surrounds_it(spark, monkeypatch):
    monkeypatch.setattr(latent_decontam, "PAIRS", 500)
    rnd, texts = random.Random(3), {}
    common, rare = [f"w{k}" for k in range(60)], [f"rare{k}" for k in range(3000)]
    items = {i: [rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(n)] for i, n in enumerate([1, 2, 15, 40, 59, 500])}
    for k in range(150):  # surroundings of common words, and of words that no item and no other document has
        around = [rnd.choice(common) if k % 2 else f"only{k}x{j}" for j in range(rnd.randint(0, 300))]
        kept = []
        for word in items[k % len(items)]:
            if rnd.random() < (0.6, 0.7, 0.8, 0.9, 1.0)[k % 5]:
                kept.append(word)
            if rnd.random() < 0.4 * (k % 3):
                kept.append(f"only{k}y{len(kept)}")
        at = rnd.randint(0, len(around))
        texts[k] = [*around[:at], *kept, *around[at:]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    force = {}
    for i, w in items.items():
        item = latent_decontam.item_of(i, " ".join(w))
        for k, words in texts.items():
            if length := leaks_by_force([x.encode() for x in words], item):
                force[k, i] = length / len(w)
    found = {(r["doc_id"], r["item_id"]): r["overlap"] for r in latent_decontam.contaminated(docs, benchmark).collect()}
    assert sum(i == 5 for _, i in force) >= 5
    assert found == force


@pytest.mark.parametrize("times", [1, 12])
def test_recall_of_the_cosine_against_the_exact_search(spark, tables, times):
    """Paraphrases that keep 60 to 100 % of an item's words, at two sizes of the corpus."""
    items = {r["item_id"]: latent_decontam.words_of(r["text"]) for r in tables("benchmark").collect()}
    texts = [r["text"] for r in tables("documents").select("text").collect() if r["text"]]
    rnd, rows = random.Random(times), []
    for k in range(len(texts) * times):
        words = texts[k % len(texts)].split(" ")[:400]
        if k < 300:
            item = items[sorted(items)[k % len(items)]]
            kept = []
            for word in item:
                kept += [word.decode()] if rnd.random() < (0.62, 0.7, 0.8, 0.9, 1.0)[k % 5] else []
                kept += [rnd.choice(words)] if rnd.random() < 0.15 * (k % 3) else []
            at = rnd.randint(0, len(words))
            words = [*words[:at], *kept, *words[at:]]
        rnd.shuffle(words) if k >= len(texts) else None
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact, found = (
        {(r["doc_id"], r["item_id"]) for r in latent_decontam.contaminated(docs, tables("benchmark"), c).collect()}
        for c in (-1, latent_decontam.COSINE)
    )
    assert found <= exact and len(exact) > 100
    assert len(found) >= 0.97 * len(exact)


def test_leaks_and_cosines_are_the_same_in_blocks_of_items(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, " ".join(f"w{int(rnd.expovariate(0.02))}" for _ in range(30))) for i in range(12)]
    docs = [(k, f"{'unheard of ' * 9}{k} x{k} {t} y{k} z{k}") for k, t in items]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"]): (r["overlap"], r["cosine"]) for r in latent_decontam.contaminated(docs, items).collect()}

    whole = found()
    monkeypatch.setattr(latent_decontam, "ITEMS", 5)
    parts = found()
    assert whole.keys() == parts.keys() and all((k, k) in whole for k in range(12))
    assert all(whole[k] == pytest.approx(parts[k], abs=1e-4) for k in whole)
    assert all(whole[k, k][1] > 0.99 for k in range(12))  # words of no item take nothing from it


def test_odd_rows_and_items(odd_docs, no_docs, spark, monkeypatch):
    monkeypatch.setattr(latent_decontam, "ITEMS", 2)
    line = " ".join(f"term{k}" for k in range(40))
    rows = [(1, line), (1, line), (2, None), (None, line), (3, ""), (4, "?!"), (5, "nothing of this is there at all")]
    items = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "item_id long, text string, doc_id double")
    found = latent_decontam.contaminated(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(7, 1), (8, 1), (9, 1), (None, 1)}
    kept = latent_decontam.leaks(odd_docs, items, odd_docs.columns, "found")
    assert kept.columns == [*odd_docs.columns, "found"] and kept.count() == odd_docs.count()
    assert latent_decontam.contaminated(no_docs, items).collect() == []
    assert latent_decontam.contaminated(odd_docs, items.where("false")).collect() == []


def test_the_pipeline(tables, spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    sf_dir = "/root/testdata/sf0.001"

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, corpus_pipeline.stored(stage(spark, left, sf_dir), f"test_{name}")
        if name != "packing":
            assert left.columns == columns and left.schema == docs.schema
            assert left.count() <= before.count()
            assert left.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, left.select(*key).collect()))


def test_stages_on_empty_and_odd_tables(odd_docs, no_docs, spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    spark.createDataFrame([(7, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        docs = docs.withColumnRenamed("row", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"odd_{name}")
            assert name == "packing" or docs.columns == columns


@pytest.mark.parametrize("cells", [0, 1 << 24])
def test_the_space_is_fitted_on_all_passages_of_all_documents(spark, monkeypatch, cells):
    """Long texts and very many short ones alike, whether the products are stored or the texts read in each step."""
    for name, value in {"CELLS": cells, "DIMS": 6, "EXTRA": 20}.items():
        monkeypatch.setattr(latent_decontam, name, value)
    rnd = random.Random(5)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(8)]
    long_texts = [" ".join(rnd.choice(topics[k]) if rnd.random() < 0.9 else f"o{j}" for j in range(4000)) for k in range(4)]
    short = [" ".join(rnd.choice(topics[4 + k % 4]) for _ in range(rnd.randint(0, 90))) for k in range(1000)]
    texts = [*long_texts, *short, None, "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(topics)], "item_id long, text string")
    vocabulary = {w.encode(): k for k, w in enumerate(sorted(w for t in topics for w in t))}
    squared = np.linspace(0.5, 3, len(vocabulary))
    product = np.zeros((len(vocabulary), len(vocabulary)))
    for text in [*texts, *map(" ".join, topics)]:
        words = latent_decontam.words_of(text)
        for at in range(0, max(1, len(words) - 32 + 16), 16):
            counts = np.bincount([vocabulary[w] for w in words[at : at + 32] if w in vocabulary], minlength=len(vocabulary))
            row = np.sqrt(counts * squared)
            if row.any():
                product += np.outer(row, row) / (row @ row)
    space = latent_decontam.latent_space(docs, items, vocabulary, squared).astype(float)
    assert space.shape == (96, 6) and np.allclose(space.T @ space, np.eye(6), atol=1e-4)
    assert np.trace(space.T @ product @ space) == pytest.approx(np.linalg.eigvalsh(product)[-6:].sum(), rel=1e-3)
