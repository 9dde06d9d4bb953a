"""Toxicity by maximum-scoring segments of token log-odds.

Every token gets the log-odds of its frequency in toxic against other labelled texts, with an informative Dirichlet prior
and only as far as they are certain, less a constant drift, so that ordinary text drifts down.  A linear scan finds
all maximal scoring segments of a text; extreme-value statistics of ordinary text tell which of them are significant for
a text of its length, and their summed evidence becomes a score by a rising curve fitted on other labelled texts.

Tokens are runs of letters, that is of ASCII letters and all characters beyond ASCII, in lower case.  A word that is no
known sign itself is judged by its first letters, so that other forms of a stem count too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import fold, labelled_sample, slices
from shelfmark.llm.zstd_quality import calibration

#: Bounds of the labelled sample the model is fitted on: texts of either class, and bytes of a text.
PER_CLASS, MAX_BYTES = 1500, 8192
#: Weight of the prior as a share of the sample, standard errors taken off a token's log-odds, drift of a token.
PRIOR, ERRORS, DRIFT = 0.1, 3.0, 0.25
#: Toxic texts from which on all ``ERRORS`` are taken off; of fewer texts fewer, as the prior shrinks their log-odds already.
ENOUGH = 200
#: Level of significance; letters of a stem, from the least on.
LEVEL, STEM = 0.05, (4, 5, 6, 7, 8)

_BREAKS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+")


def tokens(text: str | None) -> list[str]:
    # an unpaired surrogate is no letter of any word
    return text.lower().encode(errors="replace").translate(_BREAKS).decode().split() if text else []


def distinct_texts(texts: list[list[str]]) -> list[list[str]]:
    """The texts without copies and near copies of earlier ones: one of three least shingle hashes in common."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for words in texts:
        shingles = [" ".join(words[k : k + 4]).encode() for k in range(max(1, len(words) - 3))]
        keys = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in range(3)}
        if not keys & seen:
            kept.append(words)
        seen |= keys
    return kept


def maximal_segments(at: np.ndarray, score: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as first and last position and score.

    ``at`` are the positions of the positive tokens, ``score`` their scores, ``before`` the sum of all scores ahead of each.
    No segment lies in a better one, none can be extended to a better one; the scan looks at every segment a constant
    number of times.
    """
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    for p, s, low in zip(at.tolist(), score.tolist(), before.tolist(), strict=True):
        high, first = low + s, p
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= low:
                k -= 1
            if k < 0 or found[k][1] >= high:
                break
            low, first = found[k][0], found[k][2]
            del found[k:]
        found.append((low, high, first, p))
    return [(first, last, high - low) for low, high, first, last in found]


@dataclass(frozen=True)
class Model:
    """Scores of the tokens that differ from ``usual``; decay and rate of the extremes; the points of the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    usual: float = -DRIFT
    decay: float = 1.0
    rate: float = 1.0
    at: tuple[float, ...] = (0.0,)
    value: tuple[float, ...] = (0.5,)

    @cached_property
    def heads(self) -> frozenset[str]:
        """First letters of all signs, which most words do not have."""
        return frozenset(w[: STEM[0]] for w in (*self.weights, *self.stems))

    def scores(self, words: list[str]) -> list[float]:
        word, stem, heads, least = self.weights, self.stems, self.heads, STEM[0]

        def judged(w: str) -> float:
            if w in word:
                return word[w]
            return max((stem[w[:n]] for n in STEM if w[:n] in stem), default=self.usual)

        usual = self.usual
        return [judged(w) if w[:least] in heads else usual for w in words]

    def segments(self, words: list[str]) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments of a text's tokens, and the number of tokens."""
        scores = np.array(self.scores(words))
        at = np.flatnonzero(scores > 0)
        if not len(at):
            return [], len(words)
        return maximal_segments(at, scores[at], (np.cumsum(scores) - scores)[at]), len(words)

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """The segments that ordinary text of ``n`` tokens has with a probability of at most ``LEVEL``, with it."""
        rows = ((*s, -math.expm1(-self.rate * n * math.exp(-min(self.decay * s[2], 700)))) for s in found)
        return [r for r in rows if r[3] <= LEVEL]

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """How far the segments' scores exceed the usual largest one of ``n`` tokens, summed, in nats."""
        usual = math.log(max(self.rate * n, 1e-12))
        return sum(max(0.0, self.decay * s[2] - usual) for s in found)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 0.99 * np.interp(evidence, self.at, self.value) + 0.01 * evidence / (10 + evidence)


def weights(toxic: list[list[str]], other: list[list[str]], letters: int | None = None, errors: float = ERRORS) -> dict[str, float]:
    """Scores of the words (or of their first ``letters``) that are signs of the first group: certain log-odds less the drift.

    A text counts a word once; a sign is in two texts of the group or more.
    """
    counts = [Counter(w for words in group for w in {w[:letters] for w in words}) for group in (other, toxic)]
    sizes = [max(1, sum(c.values())) for c in counts]
    total = sum(sizes)
    found = {}
    for word in counts[1]:
        y0, y1 = counts[0][word], counts[1][word]
        if y1 < 2:
            continue
        prior = PRIOR * (y0 + y1)
        odds = [math.log((y + prior) / (n + PRIOR * total - y - prior)) for y, n in ((y0, sizes[0]), (y1, sizes[1]))]
        certain = odds[1] - odds[0] - errors * math.sqrt(1 / (y0 + prior) + 1 / (y1 + prior))
        if certain > DRIFT:
            found[word] = certain - DRIFT
    return found


def extremes(model: Model, texts: list[list[str]]) -> tuple[float, float]:
    """Decay and rate of the largest segment of ordinary texts.

    The decay solves sum p(s) exp(decay * s) = 1 over the scores of ordinary tokens; half a token with each known score is
    added, so that it exists.  Given the decay, the rate has a closed maximum-likelihood form.
    """
    scores = Counter(s for words in texts for s in model.scores(words))
    for s in {*model.weights.values(), *model.stems.values(), model.usual}:
        scores[s] += 0.5
    values, n = np.array(list(scores)), np.array(list(scores.values()))
    p = n / n.sum()
    low, high = 1e-6, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * values, 600))).sum() < 1 else (low, middle)
    most = [(max((s[2] for s in found), default=0.0), n) for found, n in map(model.segments, texts) if n]
    rate = len(most) / max(1e-9, sum(n * math.exp(-min(low * s, 700)) for s, n in most))
    return low, rate


def fit(docs: DataFrame, labels: DataFrame, learnable=None) -> Model:
    """Token scores, extremes and curve from a bounded sample of labelled texts.

    The curve is fitted on evidence that each half of the texts has under scores learned from the other half; the scores
    themselves then come from all texts.  The fewer toxic texts there are, the fewer standard errors are taken off a word's log-odds.
    Without two toxic and two other texts, or a sign in them, the model knows nothing and scores 0.5.
    """
    learnable = fold(F.col("doc_id"), 3) != 1 if learnable is None else learnable
    sample, sizes = labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_BYTES, learnable)
    texts = {c: distinct_texts([tokens(t) for _, k, t in sample if k == c]) for c in (0, 1)}
    if min(len(texts[0]), len(texts[1])) < 2:
        return Model()

    def learned(toxic: list[list[str]], other: list[list[str]], unseen: list[list[str]]) -> Model | None:
        errors = ERRORS * min(1.0, math.sqrt(len(toxic) / ENOUGH))
        known = Model(weights(toxic, other, None, errors), {s: v for n in STEM for s, v in weights(toxic, other, n, errors).items()})
        if not (known.weights or known.stems):
            return None
        return replace(known, **dict(zip(("decay", "rate"), extremes(known, unseen), strict=True)))

    x, y, rates = [], [], []
    for half in (0, 1):
        own = learned(texts[1][half::2], texts[0][half::2], texts[0][1 - half :: 2])
        if own is not None:
            rates.append((own.decay, own.rate))
            for c in (0, 1):
                rest = texts[c][1 - half :: 2]
                x += [own.evidence(*own.segments(w)) for w in rest]
                y += [c] * len(rest)
    known = learned(texts[1], texts[0], texts[0])
    if known is None or not rates:
        return Model()
    # texts that scores were learned from look tamer than others: extremes as the halves have them
    known = replace(known, **dict(zip(("decay", "rate"), np.mean(rates, axis=0).tolist(), strict=True)))
    at, value = calibration(np.array(x), np.array(y, float), sizes[1] / (sizes[0] + sizes[1]))
    return replace(known, at=at, value=value)


PASSAGE = "struct<start:int,end:int,score:double,p_value:double>"
SCORED = f"doc_id long, held_out boolean, score double, passages array<{PASSAGE}>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and the significant toxic passages of every row; the text alone decides.

    ``passages`` have their first character and the one after their last, their score and the probability of such a score in
    ordinary text of that length.  A null text counts as empty, has no passage and the curve's score for no evidence.
    Rows are scanned where they are, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tokens of the sample

    def spans(text: str, found: list[tuple[int, int, float, float]]) -> list[dict]:
        places = [m.span() for m in _TOKEN.finditer(text)]
        return [{"start": places[a][0], "end": places[b][1], "score": s, "p_value": p} for a, b, s, p in found]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in slices(batches, 1000):
            evidence, passages = np.zeros(batch.num_rows), []
            for row, text in enumerate(batch.column(2)):
                text = text.as_py()
                found, n = model.segments(tokens(text))
                evidence[row] = model.evidence(found, n) if found else 0.0
                found = model.significant(found, n)
                passages.append(spans(text, found) if found else [])
            columns = [batch.column(0), batch.column(1), pa.array(model.score(evidence)), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "passages"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(scanned, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, passages, predicted (1 from 0.7 on): fitted on ``labels.toxic`` outside the held-out fold."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
