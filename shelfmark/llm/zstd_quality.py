"""Quality by compression: a text is good if a dictionary of good texts shortens it more than one of bad texts.

The dictionaries are raw Zstandard dictionaries of labelled whole texts.  Every text is cut into pieces, so that it is the
dictionary and not the text's own start that shortens it, and compressed with both.  The difference of the compressed
sizes, divided by the text's size, becomes a score by a rising curve (isotonic regression) fitted on
labelled texts that are in neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.base import fold, labelled_sample, slices, text_bytes

PIECE = 2048
LEVEL = 6
#: Bounds of the labelled sample the model is fitted on: texts of either class, and bytes of a text.
PER_CLASS, MAX_BYTES = 600, 8192
#: Bytes of either dictionary.
DICTIONARY = 1 << 19


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the points of the curve from the difference to the score."""

    good: bytes = b""
    bad: bytes = b""
    at: tuple[float, ...] = (0.0,)
    value: tuple[float, ...] = (0.5,)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between the points of the curve straight lines; a hundredth of the score keeps the order beyond its ends."""
        return 0.99 * np.interp(x, self.at, self.value) + 0.01 / (1 + np.exp(-np.clip(20 * x, -30, 30)))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def made(content: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=words, write_content_size=False)

        return made(self.good), made(self.bad)


def _difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - size with the good one) / size; 0 for an empty text."""
    if not text:
        return 0.0
    total = 0
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / len(text)


def calibration(x: np.ndarray, y: np.ndarray, share: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Points of a rising curve from a difference to the share of ones, where ``share`` of all rows are ones.

    Isotonic regression by pooling neighbours; each pool gives the points of its first and last row.  Half an outcome of
    either class is added to every pool, so that no point is 0 or 1.
    """
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    pools: list[tuple[float, float, float, float]] = []  # first and last x, weight of ones, weight
    for i in np.argsort(x, kind="stable"):
        pool = (x[i], x[i], y[i] * weight[i], weight[i])
        while pools and (pools[-1][1] == pool[0] or pools[-1][2] * pool[3] >= pool[2] * pools[-1][3]):
            first, _, ones, total = pools.pop()
            pool = (first, pool[1], ones + pool[2], total + pool[3])
        pools.append(pool)
    half = 0.5 / len(x)
    points = [(at, (ones + half * share) / (total + half)) for low, high, ones, total in pools for at in (low, high)]
    rising = np.maximum.accumulate([v for _, v in points])
    return tuple(float(at) for at, _ in points), tuple(float(v) for v in rising)


def fit(docs: DataFrame, labels: DataFrame, learnable=None) -> Model:
    """Dictionaries from every second text of a bounded sample, the curve from the others.

    Without a text of each class on both sides the model knows nothing and scores 0.5.
    """
    learnable = fold(F.col("doc_id"), 3) != 1 if learnable is None else learnable
    sample, sizes = labelled_sample(docs, labels, "quality", PER_CLASS, MAX_BYTES, learnable)
    texts = {c: [t.encode() for _, k, t in sample if k == c] for c in (0, 1)}
    if min(len(texts[0]), len(texts[1])) < 2:
        return Model()
    words = {c: b"\n".join(texts[c][::2])[-DICTIONARY:] for c in (0, 1)}
    model = Model(words[1], words[0])
    good, bad = model.compressors()
    rest = [(t, c) for c in (0, 1) for t in texts[c][1::2]]
    x = np.array([_difference(t, good, bad) for t, _ in rest])
    return Model(words[1], words[0], *calibration(x, np.array([c for _, c in rest], float), sizes[1] / (sizes[0] + sizes[1])))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (else doc_id, held_out) and the score, as column ``name``, of every row; the text alone decides.

    ``score`` is between 0 and 1, higher for better texts.  A null text counts as empty; an empty text differs for
    neither dictionary and gets the curve's value there.  Rows are scored where they are, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # twice DICTIONARY bytes

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = bool(model.good and model.bad)
        good, bad = model.compressors() if known else (None, None)
        for batch in slices(batches, 1000):
            raw, at = text_bytes(batch.column(batch.num_columns - 1))
            raw = raw.tobytes()
            x = np.zeros(batch.num_rows)
            if known:
                x = np.array([_difference(raw[s:e], good, bad) for s, e in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*names, name])

    kept = [F.col(c) for c in keep] if keep else [F.col("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out")]
    rows = docs.select(*kept)
    names = rows.columns
    scored_schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select(*kept, F.col("text").alias(f"text_of_{name}")).mapInArrow(scored, scored_schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on): fitted on ``labels.quality`` outside the held-out fold."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
