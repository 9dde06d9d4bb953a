import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import importance_resampling as resampling
from shelfmark.llm.base import text_bytes
from shelfmark.llm.queries import tokenizer
from shelfmark.llm.token_counts import balanced, counter, safe_cuts, token_counts
from shelfmark.llm.word_parts import cuts_at_white_space, library_tokenizer, word_parts

ODD_TEXTS = [
    "", " ", "a", "can't, we'll 'S ,'s x'y''t 's' 're", "A<|endoftext|>b <|ENDOFTEXT|> <|endoftext|><|startoftext|>", "<| endoftext|>",
    "Ünïcode ßtraße 漢字 ÀÈÿ ×÷ é ́x", "x y z\x0bq\x0cr\x1cs\x85t", "12 345 6.7%%% ---", "İstanbul ΣΑΣ ﬁ ª º µ", "🎉🎉 a🎉b",
    "\x00\x01 a\x01b", "word " * 50 + "\n\n" + "x" * 3000, "\t\r\n",
]


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return tokenizer()


def library_counts(path, texts):
    tok = library_tokenizer(path)
    return [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_have_the_ids_that_the_library_gives_them(path):
    words = sorted({w for t in ODD_TEXTS for w in t.encode().split()})
    tok = library_tokenizer(path)
    want = [np.array(tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert word_parts(path).ids(words) == want


def test_cuts_are_lossless_and_at_white_space():
    for text in ODD_TEXTS + ["ab cd  ef\n" * 30]:
        raw = text.encode()
        for most in (1, 7, 64):
            pieces = list(safe_cuts(raw, most))
            assert b"".join(pieces) == raw
            assert all(p[:1].isspace() for p in pieces[1:])
            assert all(len(p) <= most or not re.search(rb"[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]", p[: most + 1].lstrip()) for p in pieces)
    parts = list(balanced([b"a b c d", b"", b"e" * 20, b"f"], 5, True))
    assert all(sum(len(p) for _, p in part) <= 5 or len(part) == 1 for part in parts)
    assert [r for part in parts for r, _ in part] == sorted(r for part in parts for r, _ in part)


@pytest.mark.parametrize("batch_bytes", [40, 1 << 20])
def test_counts_are_those_of_the_library(spark, path, batch_bytes):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, None), (None, "a"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(k, t, 7, 8) for k, t in rows], "doc_id long, text string, n_tokens int, n_bytes int")
    found = token_counts(docs, path, 50, batch_bytes).collect()
    want = Counter((k, len((t or "").encode()), n, n > 50) for (k, t), n in zip(rows, library_counts(path, [t or "" for _, t in rows]), strict=True))
    assert Counter(map(tuple, found)) == want


def test_counts_of_odd_and_supplied_rows(odd_docs, no_docs, tables, path):
    for docs in (odd_docs, tables("documents")):
        texts = [r["text"] or "" for r in docs.select("text").collect()]
        found = token_counts(docs, path).collect()
        assert sorted(r["n_tokens"] for r in found) == sorted(library_counts(path, texts))
    assert token_counts(no_docs, path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_files_count_whole_texts(path, name):
    other = tokenizer(name)
    assert not cuts_at_white_space(other)
    texts = ["", "Hello  world, you're", " x" * 500]
    got = counter(other)([t.encode() for t in texts])
    if name.endswith(".json"):
        assert got == library_counts(other, texts)
    else:
        from sentencepiece import SentencePieceProcessor

        assert got == [len(SentencePieceProcessor(model_file=other).encode(t)) for t in texts]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for texts, count in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            count.update(map(bucket, brute_features(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    rows = []
    for doc_id, text in docs:
        words, found = brute_features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_checksums_by_columns():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 3000)
    lengths = np.where(rng.random(3000) < 0.01, 700, rng.integers(0, 60, 3000))
    want = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert resampling.crc32_of_slices(raw, starts, lengths).tolist() == want


@pytest.mark.parametrize("size", [1, 5, 30, 1 << 22])
def test_features_of_texts_cut_anywhere(monkeypatch, size):
    monkeypatch.setattr(resampling, "BATCH", size)
    texts = ["", "a", "a b", "A b-c d e f", None, "-", "é漢 ß b9 " * 9, "long" * 30 + " z y", "  one  ", "x" * 90]
    batch = pa.array(texts)
    found = [Counter() for _ in texts]
    for at, raw, starts, sign in resampling._parts(*text_bytes(batch)):
        for row, bucket in zip(*(x.tolist() for x in resampling.features(raw, starts)), strict=True):
            found[at + row][bucket] += sign
    for text, got in zip(texts, found, strict=True):
        assert +got == Counter(zlib.crc32(f.encode()) % 10000 for f in brute_features(text)[1])


def test_resampling_against_brute_force(spark, tables, odd_docs, no_docs):
    target = tables("benchmark")
    items = [r["text"] for r in target.select("text").collect()]
    for docs in (tables("documents"), odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert Counter(map(tuple, resampling.resample(docs, target).collect())) == brute_resample(rows, items)
    assert resampling.resample(no_docs, target).collect() == []
    rows = [(k % 7, f"same words for every row of this table {k % 3} " * 4) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, resampling.resample(docs, no_docs).collect())) == brute_resample(rows, [])
