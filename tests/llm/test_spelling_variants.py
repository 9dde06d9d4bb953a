import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmark.llm import spelling_variants as variants


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, errors=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % errors == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = defaultdict(set)  # words by what is left without one code point
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w, n in words.items():
        some = {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1 :]]} | holes[w] | {w[:i] + w[i + 1 :] for i in range(len(w))}
        some = [x for x in some if x in words and near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(some), best if best and words[best] >= 10 * n else None)
    result = Counter()
    for w, (n, n_near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        result[(w, form, root, n, n_near, words[form] if form else None)] += 1
    return result


@pytest.mark.parametrize("seed", range(40))
def test_the_scan_of_sorted_lists(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc\xe9"
    rows = []
    for k in range(4):
        rows += [(k, w) for w in sorted({bytes(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40)})]
    words, lists = [w for _, w in rows], np.array([k for k, _ in rows])
    sought = np.array(sorted(rng.sample(range(len(words)), len(words) // 2)))
    found = list(zip(*(x.tolist() for x in variants.one_edit(words, lists, sought)), strict=True))
    want = {(i, j) for i in sought.tolist() for j in range(len(words)) if lists[i] == lists[j] and near(words[i], words[j])}
    assert len(found) == len(set(found))
    assert set(found) == want


@pytest.mark.parametrize("longest", [2, 10_000])
def test_near_words_come_once_from_lists_of_any_length(spark, monkeypatch, longest):
    monkeypatch.setattr(variants, "LIST", longest)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(250)}
    words |= {"prefixes" + c for c in "abcdefghij"} | {"x" * k for k in (7, 8, 9, 3000, 3001)}
    rows = spark.createDataFrame([(w, k + 2) for k, w in enumerate(sorted(words))], "word string, n long")
    found = Counter((r["word"], r["other"]) for r in variants.near_words(rows).collect())
    assert found == Counter((a, b) for a in words for b in words if a != b and near(a, b))


def test_variants_of_the_supplied_and_odd_rows(spark, tables, odd_docs, no_docs):
    for docs in (tables("documents"), odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert Counter(map(tuple, variants.spelling_variants(docs).collect())) == brute(rows)
    assert variants.spelling_variants(no_docs).collect() == []


def test_ways_from_form_to_form(spark):
    text = " ".join(["spelling"] * 400 + ["speling"] * 30 + ["spelings"] * 3 + ["ÉcolierÀ"] * 25 + ["ÉcolierÀs écolierÀ"] * 2 + ["short"] * 9 + ["A×÷bcdeF"] * 2)
    rows = [(1, text), (1, text), (None, text), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, word string")
    for errors in (31, 3, 1 << 40):
        assert Counter(map(tuple, variants.spelling_variants(docs, errors=errors).collect())) == brute(rows, errors)
    found = {r["word"]: r for r in variants.spelling_variants(docs, errors=1 << 40).collect()}
    assert found["spelings"]["form"] == "speling" and found["spelings"]["root"] == "spelling"
