"""Benchmark passages in documents by latent semantic retrieval.

A distributed randomised singular value decomposition of the passages of all documents and of the benchmark's items, with TF-IDF
weights whose document frequencies cover all documents too, gives a latent space.  Passages sized like an item, at every word of the
benchmark's vocabulary, are candidates of the item where their cosine with it in that space is ``COSINE`` or more.  A candidate
counts as a leak if the longest common subsequence of words covers most of the item, or a good part of it together with the
item's answer, that is its last sentence.

Cosines are computed only where a leak is possible at all: a passage that holds fewer of an item's rarest words than any leak
must cannot pass the comparison of subsequences whatever its cosine, so leaving it out changes no result.  The same bound with
``cosine=-1`` is the exact search, which the tests hold the recall of the cosine against.

Words are runs of letters and digits in lower case.  The vocabulary is that of all items of the benchmark; other words have no
weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.base import slices, stored

#: Words of a passage and from one to the next; latent dimensions and more for the random projection; power steps.
PASSAGE, STRIDE, DIMS, EXTRA, POWER = 32, 16, 256, 16, 2
#: Least cosine of a candidate: paraphrases that keep 60 % of an item's words lie above it, unrelated passages mostly below.
COSINE = 0.4
#: Least share of an item's words; the same with its answer; least share of the answer.
OVERLAP, OVERLAP_WITH_ANSWER, ANSWER = 0.75, 0.6, 0.8
#: A candidate holds at least one in so many of an item's words from among the rarest; words looked up at once in items.
LOOKED_UP, PAIRS = 5, 1 << 20
#: Items looked for in one pass; pairs of words up to which the products of all passages are summed once, not in each step.
ITEMS, CELLS = 1000, 1 << 24

_BREAKS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split() if text else []


def subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of an item, given as the places of each word as bits, and ``words``."""
    state = full = (1 << size) - 1
    for word in words:
        if places := masks.get(word):
            kept = state & places
            state = ((state + kept) | (state - kept)) & full
    return size - state.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for k, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << k
    return out


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[bytes, ...]
    answer: tuple[bytes, ...]


def item_of(item_id: int, text: str) -> Item:
    """An item and its answer: its last line or sentence that has three words or more, else all of it."""
    parts = [words_of(p) for p in re.split(r"[\n.!?]+", text)]
    answer = next((p for p in reversed(parts) if len(p) >= 3), words_of(text))
    return Item(item_id, tuple(words_of(text)), tuple(answer))


@dataclass(frozen=True)
class Model:
    """Items, their vocabulary with squared weights, the space and the items in it.

    An item of n words has a leak only where a stretch holds at least ``needed`` of them, so all but n - ``needed`` of any choice
    of its words.  Of the n - ``needed`` + ``least`` rarest a stretch therefore holds at least ``least``: those are looked up.
    ``items_at[first[t] : first[t + 1]]`` are the places of the items that look term t up.
    """

    items: tuple[Item, ...]
    vocabulary: dict[bytes, int]
    squared: np.ndarray
    space: np.ndarray
    latent: np.ndarray
    needed: np.ndarray
    least: np.ndarray
    stretch: np.ndarray
    first: np.ndarray
    items_at: np.ndarray

    def vector(self, terms: list[int]) -> np.ndarray:
        """Latent vector of known terms; a term's weight is the root of its count times its rarity."""
        counts = Counter(terms)
        at = list(counts)
        weights = np.sqrt(self.squared[at] * list(counts.values())).astype(np.float32)
        return weights @ self.space[at]

    def cosine(self, number: int, words: list[bytes]) -> float:
        """Latent cosine of an item and a stretch of words."""
        terms = [t for w in words if (t := self.vocabulary.get(w)) is not None]
        return min(1.0, float(self.vector(terms) @ self.latent[number]) / math.sqrt(self.squared[terms].sum()))

    def terms(self, words: list[bytes]) -> np.ndarray:
        """The term of every word, one more than the last where it has none."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(len(self.vocabulary))), np.int64, len(words))

    def near(self, number: int, terms: np.ndarray, first: int, last: int, least: float) -> list[list[int]]:
        """The parts of a document between two words that passages with a cosine of ``least`` or more with an item cover."""
        place = first + np.flatnonzero(terms[first:last] < len(self.vocabulary))
        if not len(place):
            return []
        term = terms[place]
        sums = np.zeros((len(place) + 1, self.space.shape[1]), np.float32)
        np.cumsum(self.space[term] * np.sqrt(self.squared[term])[:, None].astype(np.float32), axis=0, out=sums[1:])
        reach, item = int(self.stretch[number]), self.latent[number]
        ends = np.searchsorted(place, place + reach)
        passages = sums[ends] - sums[:-1]
        scale = np.linalg.norm(passages, axis=1) * np.linalg.norm(item)
        parts: list[list[int]] = []
        for at in place[passages @ item >= least * np.maximum(scale, 1e-12)].tolist():
            if parts and at <= parts[-1][1]:
                parts[-1][1] = min(last, at + reach)
            else:
                parts.append([at, min(last, at + reach)])
        return parts

    def possible(self, at: np.ndarray) -> dict[int, list[list[int]]]:
        """By an item's place, the parts of a document of these terms (first word, end) outside which no stretch can be a leak."""
        low, n = self.first[at], self.first[at + 1] - self.first[at]
        pairs, longest = np.cumsum(n), int(self.stretch.max())
        found: dict[int, list[list[int]]] = {}
        start, size = 0, len(at)
        while start < size and pairs[-1]:
            # so many words at once that what is looked up stays bounded; stretches across the border are seen after it
            end = max(start + 2 * longest, int(np.searchsorted(pairs, pairs[start] + PAIRS)))
            k = n[start:end]
            place = np.repeat(np.arange(start, min(end, size)), k)
            item = self.items_at[np.arange(len(place)) + np.repeat(low[start:end] - np.cumsum(k) + k, k)]
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            last = np.arange(len(item)) + self.least[item] - 1
            near = np.flatnonzero(last < len(item))
            near = near[item[last[near]] == item[near]]
            near = near[place[last[near]] - place[near] < self.stretch[item[near]]]
            for number, one, two in zip(item[near].tolist(), place[near].tolist(), place[last[near]].tolist(), strict=True):
                reach, parts = int(self.stretch[number]), found.setdefault(number, [])
                begin, stop = max(0, two - reach + 1), min(size, one + reach)
                if parts and begin <= parts[-1][1]:
                    parts[-1][1] = max(stop, parts[-1][1])
                else:
                    parts.append([begin, stop])
            if end >= size:
                break
            start = end - longest
        return found

    def matches(self, words: list[bytes], prepared: list[tuple[dict, dict, dict]], cosine: float) -> list[dict]:
        """The leaks of a document, the best stretch of each item."""
        out, terms = [], self.terms(words)
        for number, parts in sorted(self.possible(terms).items()):
            best, most = None, prepared[number][2]
            for whole in parts:
                shared = Counter(w for w in words[slice(*whole)] if w in most)
                if sum(min(n, most[w]) for w, n in shared.items()) < self.needed[number]:  # no stretch of it can hold enough
                    continue
                for first, last in self.near(number, terms, *whole, cosine) if cosine > -1 else [whole]:
                    best = self._best(number, words, first, last, prepared[number], best)
            if best is not None:
                overlap, answer, at, end = best
                out.append({
                    "item_id": self.items[number].item_id, "cosine": self.cosine(number, words[at:end]),
                    "overlap": overlap / len(self.items[number].words), "answer": answer, "start_word": at, "end_word": end,
                })
        return out

    def _best(self, number: int, words: list[bytes], first: int, last: int, prepared: tuple, best: tuple | None) -> tuple | None:
        """The stretch with the longest common subsequence that counts as a leak: its length, answer, first word and end.

        Stretches that begin at a word of the item hold whatever others hold.  ``shared`` counts the words a stretch has in common
        with the item, each as often as in the item: no subsequence is longer.
        """
        item, (all_masks, answer_masks, most) = self.items[number], prepared
        size, reach, needed = len(item.words), int(self.stretch[number]), int(self.needed[number])
        hits = [k for k in range(first, last) if words[k] in all_masks]
        seen, shared, end = dict.fromkeys(most, 0), 0, 0
        for begin, at in enumerate(hits):
            while end < len(hits) and hits[end] < at + reach:
                word = words[hits[end]]
                seen[word] += 1
                shared += seen[word] <= most[word]
                end += 1
            if shared >= needed and (best is None or shared > best[0]):
                part = [words[k] for k in hits[begin:end]]
                length = subsequence(all_masks, size, part)
                if length >= needed and (best is None or length > best[0]):
                    answer = subsequence(answer_masks, len(item.answer), part) >= ANSWER * len(item.answer)
                    if answer or length / size >= OVERLAP:
                        best = (length, answer, at, min(at + reach, len(words)))
            word = words[at]
            shared -= seen[word] <= most[word]
            seen[word] -= 1
        return best


def lookup(items: list[Item], vocabulary: dict[bytes, int], frequency: np.ndarray) -> dict[str, np.ndarray]:
    """``needed``, ``least``, ``stretch``, ``first`` and ``items_at`` of a model."""
    needed, least, term, place = [], [], [], []
    for number, item in enumerate(items):
        size = len(item.words)
        need = next(k for k in range(size + 1) if k / size >= OVERLAP_WITH_ANSWER)
        few = min(need, max(1, size // LOOKED_UP))
        rarest = sorted((vocabulary[w] for w in item.words), key=lambda t: (frequency[t], t))[: size - need + few]
        needed.append(need)
        least.append(few)
        distinct = sorted(set(rarest))
        term += distinct
        place += [number] * len(distinct)
    term, place = np.array(term), np.array(place, np.int16 if len(items) < 1 << 15 else np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary) + 1))])
    sizes = np.array([len(i.words) for i in items])
    return {
        "needed": np.array(needed), "least": np.array(least), "stretch": sizes + sizes // 2 + 2,
        "first": first, "items_at": place[np.argsort(term, kind="stable")],
    }


MATCH = T.ArrayType(
    T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("overlap", T.DoubleType()),
        T.StructField("answer", T.BooleanType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
    ])
)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """The number of documents and in how many of them each word of the vocabulary is; every document is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value, 0
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, 1000):
            for text in batch.column(0):
                n += 1
                counts.update(known.keys() & set(words_of(text.as_py())))
        found = np.zeros(len(known) + 1, np.int64)
        for word, count in counts.items():
            found[known[word]] = count
        found[-1] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def _weighted(texts: list[str | None], vocabulary: dict[bytes, int], squared: np.ndarray) -> tuple[np.ndarray, ...]:
    """The passages of texts as a sparse matrix: passage, term (both ascending) and weight, rows of length one."""
    words = [words_of(text) for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.maximum(1, -(-(sizes - PASSAGE + STRIDE) // STRIDE))
    term = np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
    known = np.flatnonzero(term >= 0)
    text = np.repeat(np.arange(len(words)), sizes)[known]
    term, step = term[known], (known - (np.cumsum(sizes) - sizes)[text]) // STRIDE
    counts, base = counts[text], (np.cumsum(counts) - counts)[text]
    size, codes = max(1, len(vocabulary)), []
    for back in range(PASSAGE // STRIDE):  # a word is in that many passages
        owner = step - back
        held = (owner >= 0) & (owner < counts)
        codes.append((owner + base)[held] * size + term[held])
    codes = np.concatenate(codes)
    places, counts = np.unique(codes, return_counts=True)
    owner, term = places // size, places % size
    weight = np.sqrt(counts * squared[term])
    return owner, term, weight / np.sqrt(np.bincount(owner, weight * weight))[owner]


def _partial(terms: np.ndarray, rows: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sums of a task, a row of them for each term, in batches of some megabytes."""
    group: list[tuple[int, bytes]] = []
    held = 0
    for term, row in zip(terms.tolist(), rows, strict=True):
        group.append((term, row.astype(np.float32).tobytes()))
        held += len(group[-1][1])
        if held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*group, strict=True)], names=["term", "part"])
            group, held = [], 0
    if group:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*group, strict=True)], names=["term", "part"])


def _summed(parts: DataFrame) -> DataFrame:
    """One row for each term: the sum of its rows in all tasks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(part.as_buffer(), np.float32)
                sums[term] = sums[term] + row if term in sums else row.astype(np.float64)
        yield from _partial(np.array(list(sums), np.int64), iter(sums.values()))

    return parts.repartition("term").mapInArrow(added, "term long, part binary")


def latent_space(docs: DataFrame, items: DataFrame, vocabulary: dict[bytes, int], squared: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (columns) of the weighted passages of all documents and of the items.

    A random block is multiplied by the passages and their transpose in tasks, whose sums are added by term, and made orthogonal
    on the driver, ``POWER`` times; the passages themselves stay in the tasks.  Of a vocabulary with at most ``CELLS`` pairs of words
    the passages' transpose times the passages is summed once and stored, and each step multiplies by it; with more, each step
    reads all texts, as no task could hold the pairs.
    """
    spark, size = docs.sparkSession, len(vocabulary)
    width = min(size, DIMS + EXTRA)
    texts = docs.select("text").unionByName(items.select("text"))
    shared = spark.sparkContext.broadcast((vocabulary, squared))
    #: where the row of a term begins in the upper triangle, less the term
    row_of = np.arange(size) * size - np.arange(size) * (np.arange(size) + 1) // 2

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * (size + 1) // 2, np.float32)
        for batch in slices(batches, 200):
            owner, term, weight = _weighted(batch.column(0).to_pylist(), *shared.value)
            weight, row = weight.astype(np.float32), row_of[term]
            for apart in range(min(PASSAGE, len(term))):
                first = np.flatnonzero(owner[: len(owner) - apart] == owner[apart:])
                np.add.at(sums, row[first] + term[first + apart], weight[first] * weight[first + apart])
        held = np.flatnonzero(sums[row_of + np.arange(size)])
        yield from _partial(held, (sums[row_of[t] + t : row_of[t] + size] for t in held.tolist()))

    few = size * (size + 1) // 2 <= CELLS
    products = stored(_summed(texts.mapInArrow(squares, "term long, part binary")), "products").coalesce(4) if few else None

    def step(block: np.ndarray) -> np.ndarray:
        given = spark.sparkContext.broadcast(block)

        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, out = given.value, np.zeros(given.value.shape, np.float64)
            for batch in batches:
                for term, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    row = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                    at = np.flatnonzero(row)
                    out[term] += row[at] @ x[term + at]
                    at = at[at > 0]
                    out[term + at] += np.outer(row[at], x[term])
            held = np.flatnonzero(out.any(axis=1))
            yield from _partial(held, iter(out[held]))

        def read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, out = given.value, np.zeros(given.value.shape, np.float64)
            for batch in slices(batches, 200):
                owner, term, weight = _weighted(batch.column(0).to_pylist(), *shared.value)
                borders = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
                for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    out[term[a:b]] += np.outer(weight[a:b], weight[a:b] @ x[term[a:b]])
            held = np.flatnonzero(out.any(axis=1))
            yield from _partial(held, iter(out[held]))

        parts = (products.mapInArrow(multiplied, "term long, part binary") if few
                 else texts.mapInArrow(read_again, "term long, part binary"))
        done = np.zeros(block.shape)
        for r in _summed(parts).toLocalIterator():
            done[r["term"]] = np.frombuffer(r["part"], np.float32)
        given.unpersist()
        return done

    block = np.linalg.qr(np.random.default_rng(11).standard_normal((size, width)))[0]
    for _ in range(POWER):
        block = np.linalg.qr(step(block))[0]
    values, turn = np.linalg.eigh(block.T @ step(block))
    return (block @ turn[:, np.argsort(-values)[:DIMS]]).astype(np.float32)


@dataclass(frozen=True)
class Words:
    """The vocabulary of a benchmark, the number of documents with each word, squared weights and the space."""

    vocabulary: dict[bytes, int]
    frequency: np.ndarray
    squared: np.ndarray
    space: np.ndarray


def fit(docs: DataFrame, items: DataFrame) -> Words | None:
    """One vocabulary and space for all items, so that blocks of items share them; without a word in any item there is none."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = {w for t in batch.column(0) for w in words_of(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    words = items.select("text").mapInArrow(distinct, "word binary").distinct().collect()  # the model has them all anyway
    if not words:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted(bytes(r["word"]) for r in words))}
    total, frequency = document_frequencies(docs, vocabulary)
    squared = np.square(np.log((2 + total) / (1 + frequency)) + 0.1)
    return Words(vocabulary, frequency, squared, latent_space(docs, items, vocabulary, squared))


def model_of(words: Words, rows: list[tuple[int, str]]) -> Model | None:
    """The model of a block of items; items without a word are left out, and without any there is no model."""
    items = [i for i in (item_of(item_id, text) for item_id, text in rows) if i.words]
    if not items:
        return None
    looked_up = lookup(items, words.vocabulary, words.frequency)
    model = Model(tuple(items), words.vocabulary, words.squared, words.space, np.zeros((0, words.space.shape[1])), **looked_up)
    latent = []
    for item in items:
        terms = [words.vocabulary[w] for w in item.words]
        y, norm = model.vector(terms).astype(np.float64), math.sqrt(words.squared[terms].sum())
        # the space keeps the share |y|^2 / norm^2 of an item; the cosine is relative to it
        latent.append(y * norm / max(float(y @ y), 1e-12))
    return replace(model, latent=np.array(latent, np.float32))


def leaks(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], column: str = "matches", cosine: float = COSINE
) -> DataFrame:
    """The columns ``keep`` of every row and ``column``: item_id, cosine, overlap, answer, start_word and end_word of each leak.

    Null and empty texts match nothing; items with a null id or text, or without a word, are not looked for.  Items are taken in
    blocks of ``ITEMS``, each a pass over all rows; rows are searched where they are, without a shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS))
    words = fit(docs, items)
    out = docs.select(*keep, F.col("text").alias(f"text_of_{column}"))
    found = []
    for block in range(blocks) if words else ():
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        model = model_of(words, sorted(tuple(r) for r in part.collect()))
        if model is not None:
            name = f"{column}_{block}"
            out = _searched(out, model, name, f"text_of_{column}", cosine)
            found.append(name)
    matches = F.concat(*found) if found else F.array().cast(MATCH)
    return out.select(*keep, matches.alias(column))


def _searched(rows: DataFrame, model: Model, name: str, text: str, cosine: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # ITEMS items and the benchmark's words
    at = rows.columns.index(text)
    names = [*rows.columns, name]
    kind = pa.list_(pa.struct([
        ("item_id", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer", pa.bool_()),
        ("start_word", pa.int32()), ("end_word", pa.int32()),
    ]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        prepared = [(masks_of(list(i.words)), masks_of(list(i.answer)), Counter(i.words)) for i in model.items]
        for batch in slices(batches, 1000):
            found = [model.matches(words, prepared, cosine) if (words := words_of(t.as_py())) else [] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    return rows.mapInArrow(searched, T.StructType([*rows.schema.fields, T.StructField(name, MATCH)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, overlap, answer, start_word, end_word: one row for each leak of an item into a row of ``docs``."""
    rows = leaks(docs, benchmark, ["doc_id"], cosine=cosine).select("doc_id", F.explode("matches").alias("m"))
    return rows.select(F.col("doc_id").cast("long"), "m.item_id", "m.cosine", "m.overlap", "m.answer", "m.start_word", "m.end_word")
