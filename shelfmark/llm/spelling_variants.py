"""Spelling variants: words of a corpus that differ by one edit, each led to the much more frequent form near it.

Words are counted in tasks and summed over the corpus.  Near words are found by dynamic programming over sorted lists: the band of
the edit matrix around the diagonal is computed once for every prefix that neighbours in a list share, for all words that
are sought there, and a range of the list is skipped as soon as its shared prefix is more than one edit away from every
prefix of the word sought.

Lists stay short whatever the vocabulary.  One edit leaves the first or the last half of a word as it was, so words meet in
lists of an equal half and an equal length (the longer of two meets the shorter's); a list of more than ``LIST`` words is
split in the same way by the part that is not yet known to be equal.  A pair is taken only from the list that the place of its first
difference leads to, so it comes once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least so many times the occurrences of its variant.
TIMES = 10
#: One run in so many loses a code point, as its checksum has it.
ERRORS = 31
#: Words that a task counts before it passes them on; words of a list; words of lists that are worked on together; of them, sought at once.
COUNTED, LIST, CHUNK, SOUGHT = 200_000, 10_000, 20_000, 4096

_links = "word string, other string, other_n long"


def runs(raw: bytes, doc_id: str, errors: int, least: int) -> Iterator[str]:
    """The runs of letters of a text with their errors made, as far as ``least`` code points are left."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    # bytes.lower changes A to Z only
    for found in re.compile("[a-zÀ-ÿ]{%d,}" % least).finditer(raw.lower().decode()):
        run = found[0]
        h = zlib.crc32(run.encode(), prefix)
        if h % errors == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run


def word_counts(docs: DataFrame, errors: int = ERRORS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words with at least ``least_length`` code points and ``least_count`` occurrences.

    A null id counts as the empty text in the checksums; null texts have no words.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, raw in zip(ids, texts, strict=True):
                for word in runs(raw or b"", doc_id or "", errors, least_length):
                    counts[word] = counts.get(word, 0) + 1
                    if len(counts) >= COUNTED:
                        yield flush()
        if counts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(windows: list[bytes], lists: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs of one list with a in ``sought`` that differ by exactly one inserted, deleted or replaced byte.

    ``windows`` are the distinct words of each list in order, list after list; ``lists`` numbers the list of each.
    Step d has a node for every range of words that share d bytes, and for every word sought the nodes whose shared prefix is at
    most one edit from a prefix of it, with the three entries of the matrix row that can hold 0 or 1.
    """
    flat = np.frombuffer(b"".join(windows) or b"\0", np.uint8)
    size = np.fromiter(map(len, windows), np.int64, len(windows))
    begin = np.cumsum(size) - size
    last = len(flat) - 1

    def letter(word: np.ndarray, at: int) -> np.ndarray:
        """The byte of each word at a place, 0 beyond its end."""
        return np.where((size[word] > at) & (at >= 0), flat[np.clip(begin[word] + at, 0, last)], 0)

    every = np.arange(len(windows))
    opens = np.ones(len(windows), bool)
    opens[1:] = lists[1:] != lists[:-1]
    query, node = sought, np.cumsum(opens)[sought] - 1
    before, here, after = (np.full(len(sought), v, np.uint8) for v in (2, 0, 1))
    found = []
    d = 0
    while len(query):
        starts = np.flatnonzero(opens)
        own = letter(every, d)
        opens = opens.copy()
        opens[1:] |= own[1:] != own[:-1]
        deeper = np.flatnonzero(opens)
        # the ranges that a range falls into
        child = np.searchsorted(deeper, starts)
        count = np.diff(np.append(child, len(deeper)))
        many = count[node]
        total = int(many.sum())
        parent = np.repeat(np.arange(len(query)), many)
        node = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(child[node], many)
        byte = own[deeper[node]]
        going = byte > 0  # 0: the word has ended
        parent, node, byte = parent[going], node[going], byte[going]
        query, before, here, after = query[parent], before[parent], here[parent], after[parent]
        length = size[query]
        low = np.minimum(before + (letter(query, d - 1) != byte), here + 1)
        mid = np.minimum(np.minimum(here + (letter(query, d) != byte), after + 1), low + 1)
        mid[length < d + 1] = 2
        high = np.minimum(after + (letter(query, d + 1) != byte), mid + 1)
        high[length < d + 2] = 2
        d += 1
        alive = np.minimum(np.minimum(low, mid), high) <= 1
        query, node = query[alive], node[alive]
        before, here, after = (np.minimum(x[alive], 2).astype(np.uint8) for x in (low, mid, high))
        word = deeper[node]
        beyond = size[query] - d
        distance = np.select([beyond == -1, beyond == 0, beyond == 1], [before, here, after], 2)
        hit = (size[word] == d) & (distance == 1)
        found.append((query[hit], word[hit]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    """Links between the words of whole lists; rows are (list, word, n, m, a, c)."""
    keyed = []
    for _, word, n, m, a, c in rows:
        raw = word.encode("latin-1")  # one byte for each code point
        end = len(raw) - c
        keyed.append(((m, a, c, raw[:a], raw[end:]), raw[a:end], len(raw) == m, word, n))
    keyed.sort()
    windows = [k[1] for k in keyed]
    lists = np.zeros(len(keyed), np.int64)
    lists[1:] = np.cumsum([x[0] != y[0] for x, y in zip(keyed, keyed[1:], strict=False)])
    sought = np.flatnonzero(np.array([k[2] for k in keyed], bool))
    words, others, counts = [], [], []
    for part in np.array_split(sought, -(-len(sought) // SOUGHT)) if len(sought) else []:
        for i, j in zip(*(x.tolist() for x in one_edit(windows, lists, part)), strict=True):
            a, b = keyed[i], keyed[j]
            if not b[2]:  # the longer word is not sought itself
                if a[0][2] and b[1].startswith(a[1]):
                    continue  # the first difference lies behind this list's part of the words
                words.append(b[3])
                others.append(a[3])
                counts.append(a[4])
            words.append(a[3])
            others.append(b[3])
            counts.append(b[4])
    columns = [pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "other", "other_n"])


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the lists of a task, which come one after the other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= CHUNK and held[-1][0] != row[0]:
                yield _linked(held)
                held = []
            held.append(row)
    if held:
        yield _linked(held)


def _split(rows: DataFrame) -> DataFrame:
    """Rows in the lists of either half of what is not yet known: word, n, m, a, c become such rows and their ``list``.

    In its list a word of m or m + 1 code points shares the first ``a`` and the last ``c`` with all others.
    """
    half = F.expr("(m - a - c) div 2").cast("int")
    left = F.struct((F.col("a") + half).alias("a"), F.col("c"))
    right = F.struct(F.col("a"), (F.col("m") - F.col("a") - half).cast("int").alias("c"))
    both = rows.withColumn("to", F.explode(F.array(left, right))).select("word", "n", "m", "to.a", "to.c")
    ends = [F.expr("substring(word, 1, a)"), F.expr("substring(word, length(word) - c + 1, c)")]
    return both.withColumn("list", F.xxhash64("m", "a", "c", *ends))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, other, other_n for either direction of each pair of words (word, n; distinct) that differ by one edit."""
    roles = F.array(F.length("word"), F.length("word") - 1)
    rows = vocabulary.withColumn("m", F.explode(roles)).where(F.col("m") >= F.lit(1))
    rows = _split(rows.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("c")))
    found = None
    while True:
        long = rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max(F.expr("m - a - c")).alias("open"))
        # a list whose words differ in one place has as many as there are letters there, at most
        long = stored(long.where((F.col("size") > LIST) & (F.col("open") > 1)).select("list"), "long_lists")
        some = not long.isEmpty()
        now = rows.join(long, "list", "left_anti") if some else rows
        now = now.select("list", "word", "n", "m", "a", "c").repartition("list").sortWithinPartitions("list")
        links = now.mapInArrow(_in_lists, _links)
        found = links if found is None else found.unionByName(links)
        if not some:
            return found
        rows = stored(_split(rows.join(long, "list", "left_semi")), "split_lists")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the end of the way from form to form.

    Every form has ``TIMES`` the occurrences of the word before, so ways are short; each turn doubles the steps taken.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = now.join(on, "root", "left")
        then = stored(then.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = TIMES, errors: int = ERRORS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Ties between near words of one count go to the smaller in code-point order.  ``form`` and ``form_n`` are null and ``root`` is
    the word itself where no near word is frequent enough.  Null and empty texts have no words; rows with one id and text
    count each; an empty table gives no rows.
    """
    words = stored(word_counts(docs, errors), "words")
    links = near_words(words)
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    most = -F.col("best.less")
    led = F.col("best").isNotNull() & (most >= F.lit(times) * F.col("n"))
    table = stored(
        words.join(best, "word", "left").select(
            "word", F.when(led, F.col("best.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, most).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(table.where(F.col("form").isNotNull()))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
