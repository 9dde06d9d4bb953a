"""Language by cross-parsing entropy.

For every language a suffix automaton holds a bounded sample of its text.  A text is parsed against each automaton into
phrases, each the longest match that starts where the last one ended; few phrases mean that the text is like the
sample.  With c phrases over n symbols and a sample of N symbols, c * log2(N) / n estimates the cross entropy in bits a
symbol, and the language with the least wins.

Symbols are the bytes of the lower-cased text; every run of other ASCII characters than letters is one space.  Texts are
parsed in blocks of ``BLOCK`` symbols, so that all blocks of a batch step together; a block's end ends a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import fold, slices, text_bytes

BLOCK = 256
#: Bounds of the labelled sample: rows looked at a language, bytes of a text among them, symbols of an automaton.
PER_LANGUAGE, MIN_BYTES, MAX_BYTES, SYMBOLS = 96, 64, 4096, 24_000
#: How much the scores of languages differ for a given difference of the entropy's bits.
SHARPNESS = 0.1

_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLDED[128:] = np.arange(128, 256)


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lower-cased UTF-8 texts and where each text starts; a text has no space at its start."""
    folded = _FOLDED[raw]
    space = folded == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    starts = at[:-1][at[:-1] < len(raw)]
    keep[starts] = ~space[starts]
    counts = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], counts[at]


class SuffixAutomaton:
    """Transitions of the smallest automaton that accepts all substrings of a sample."""

    def __init__(self, sample: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sample:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = state
                at = link[at]
            if at >= 0:
                to = self.next[at][symbol]
                if length[to] == length[at] + 1:
                    link[state] = to
                else:
                    split = len(self.next)
                    self.next.append(dict(self.next[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    link[to] = link[state] = split
                    while at >= 0 and self.next[at].get(symbol) == to:
                        self.next[at][symbol] = split
                        at = link[at]
            last = state


@dataclass(frozen=True)
class Model:
    """``table[state + code]``: twice the next state (times the alphabet's size), plus one where a phrase ends before."""

    languages: tuple[str, ...]
    codes: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def phrases(self, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        codes = self.codes[texts]
        blocks = -(-np.diff(at) // BLOCK)
        owner = np.repeat(np.arange(len(blocks)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        start = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        size = np.minimum(BLOCK, at[1:][owner] - start)
        order = np.argsort(-size, kind="stable")  # blocks that end early stand last and drop out
        start, size = start[order], size[order]
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than each step
        out = np.zeros((len(blocks), len(self.languages)))
        for k, root in enumerate(self.roots):
            state = np.full(len(start), root, np.int64)
            ends = np.ones(len(start), np.int32)  # the last phrase of a block
            for step in range(int(size[0]) if len(size) else 0):
                n = live[step]
                to = self.table[state[:n] + codes[start[:n] + step]]
                ends[:n] += to & 1
                state[:n] = to >> 1
            out[:, k] = np.bincount(owner[order], weights=ends, minlength=len(blocks))
        return out

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (ties: the first in order) and its share of the score of all."""
        texts, at = symbols(raw, at)
        size = np.diff(at)
        cost = self.phrases(texts, at) * self.bits
        best = cost.argmin(axis=1) if len(cost) else np.zeros(0, int)
        gap = cost - cost.min(axis=1, keepdims=True)
        share = 1 / np.exp2(-SHARPNESS * np.minimum(gap, 1e4)).sum(axis=1)
        return best, np.where(size > 0, share, 0.0)


def build(samples: dict[str, bytes]) -> Model:
    """Automata of the samples, one table for all; a symbol that no sample has ends a phrase in every state."""
    languages = tuple(sorted(samples))
    texts = {}
    for language in languages:
        raw = np.frombuffer(samples[language], np.uint8)
        texts[language] = symbols(raw, np.array([0, len(raw)]))[0].tobytes()[:SYMBOLS]
    known = sorted(set().union(*map(set, texts.values())) if texts else set())
    codes = np.full(256, len(known), np.int64)
    codes[known] = np.arange(len(known))
    width = len(known) + 1
    tables, roots, base = [], [], 0
    for language in languages:
        automaton = SuffixAutomaton(texts[language])
        root_row = np.ones(width, np.int64)  # unknown to this language: back at the root, a phrase ended
        for symbol, to in automaton.next[0].items():
            root_row[codes[symbol]] = 2 * to * width + 1
        table = np.tile(root_row, (len(automaton.next), 1))
        for state, moves in enumerate(automaton.next):
            for symbol, to in moves.items():
                table[state, codes[symbol]] = 2 * to * width
        tables.append(table.ravel() + 2 * base)
        roots.append(base)
        base += table.size
    table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
    bits = np.array([np.log2(max(2, len(texts[x]))) for x in languages])
    # int32 holds the doubled places of more than a hundred languages; more need 64 bits
    kind = np.int32 if 2 * base < 2**31 else np.int64
    return Model(languages, codes, table.astype(kind), np.array(roots, np.int64), bits)


def fit(docs: DataFrame, learnable=None) -> Model:
    """Automata over a bounded sample of the rows with a language outside the held-out fold.

    Of every language about ``PER_LANGUAGE`` texts of ``MIN_BYTES`` to ``MAX_BYTES`` bytes are looked at, those with the
    smallest hash of their id and text; a language that has no such text is learned from its shorter texts and the beginnings of
    its longer ones.  Repeated rows count once.  The first ``SYMBOLS`` symbols of a language's sequence are kept.
    """
    learnable = fold(F.col("doc_id"), 4) != 2 if learnable is None else learnable
    rows = docs.select("doc_id", "text", "lang").where(learnable & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    usual = F.octet_length("text").between(MIN_BYTES, MAX_BYTES)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count_if(usual).alias("usual"), F.count(F.lit(1)).alias("n")).collect()  # a row a language
    samples, below = {}, F.lit(False)
    for r in sizes:
        bound = int((1 << 30) * min(1.0, PER_LANGUAGE / (r["usual"] or r["n"])))
        below = below | ((F.col("lang") == r["lang"]) & (usual if r["usual"] else F.lit(True)) & (mark <= bound))
    # copies of one row meet in partial aggregates, so a hot row is one
    chosen = rows.where(below).groupBy("lang", mark.alias("mark")).agg(F.min(F.substring("text", 1, MAX_BYTES)).alias("text"))
    for r in sorted(chosen.collect() if sizes else [], key=lambda r: (r["lang"], r["mark"])):
        samples[r["lang"]] = samples.get(r["lang"], b"") + r["text"].lower().encode() + b"\n"
    return build(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text decides.

    A null text, one without a letter, and every text if no language was learned, get ``und`` and the score 0.  Rows are
    parsed where they are, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SYMBOLS for each language
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.languages, "und"], dtype=object)
        for batch in slices(batches, 500):
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            best, share = np.full(batch.num_rows, len(labels) - 1), np.zeros(batch.num_rows)
            if model.languages:
                best, share = model.predict(*text_bytes(batch.column(2)))
                best = np.where(letters, best, len(labels) - 1)
                share = np.where(letters, share, 0.0)
            columns = [batch.column(0), batch.column(1), pa.array(labels[best], pa.string()), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.lower("text").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    return rows.mapInArrow(parsed, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict all rows."""
    return predict(docs, fit(docs))
