"""Token counts of whole texts: batches of about equal bytes are encoded inside tasks, and only lengths leave them.

Rows stay where they are: the texts of an Arrow batch are dealt out again into batches of about ``BATCH`` bytes, whatever
their number, and a text longer than that is cut at white space, where the tokenizer's file proves that no token and no
special string can span the cut.  Files that prove no such place (and sentencepiece models) get whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import slices
from shelfmark.llm.word_parts import Memory, cuts_at_white_space, distinct_words, library_tokenizer, word_parts

#: Bytes of text that are encoded together, and rows they may come from.
BATCH, ROWS = 4 << 20, 4096
LIMIT = 2048
SPACES = [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"]


def safe_cuts(raw: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of at most ``most`` bytes, cut before white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > most:
        end = max(raw.rfind(space, at + 1, at + most + 1) for space in SPACES)
        if end < 0:
            end = min((e for space in SPACES if (e := raw.find(space, at + most)) >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    if at < len(raw) or not raw:
        yield raw[at:]


def balanced(texts: list[bytes], most: int, cut: bool) -> Iterator[list[tuple[int, bytes]]]:
    """Batches of (row, piece) of at most ``most`` bytes, or of one piece that cannot be cut."""
    batch, size = [], 0
    for row, raw in enumerate(texts):
        for piece in safe_cuts(raw, most) if cut and len(raw) > most else [raw]:
            if batch and size + len(piece) > most:
                yield batch
                batch, size = [], 0
            batch.append((row, piece))
            size += len(piece)
    if batch:
        yield batch


class WordCounter:
    """Lengths of pieces by the lengths of their words, each new word of a batch encoded once."""

    def __init__(self, path: str):
        self.parts = word_parts(path)
        self.known = Memory()

    def __call__(self, pieces: list[bytes]) -> list[int]:
        self.known.trim()
        known = self.known
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        words, number, per_piece = distinct_words(np.frombuffer(b"".join(pieces), np.uint8), starts)
        new = [w for w in words if w not in known]
        known.update((word, len(ids) >> 2) for word, ids in zip(new, self.parts.ids(new), strict=True))
        lengths = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        running = np.concatenate([[0], np.cumsum(lengths[number])])
        ends = np.cumsum(per_piece)
        return (running[ends] - running[ends - per_piece]).tolist()


class TextCounter:
    """Lengths of whole texts by the library of a tokenizer's file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: map(len, model.encode(texts, num_threads=1))
        else:
            tokenizer = library_tokenizer(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda texts: map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def __call__(self, pieces: list[bytes]) -> list[int]:
        return list(self.lengths([p.decode() for p in pieces]))


@cache
def counter(path: str) -> WordCounter | TextCounter:
    """One for each Python worker, which serves many tasks."""
    return WordCounter(path) if cuts_at_white_space(path) else TextCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null text counts as empty: no bytes, no tokens.  Null and repeated ids and repeated texts are ordinary rows; an empty
    table gives none.  No begin, end or other special token is added; special strings in a text count as the library reads them.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(tokenizer), cuts_at_white_space(tokenizer)
        for batch in slices(batches, ROWS):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = [0] * len(texts)
            for part in balanced(texts, batch_bytes, cut):
                for (row, _), n in zip(part, count([raw for _, raw in part]), strict=True):
                    tokens[row] += n
            sizes = [len(raw) for raw in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
