"""Documents as token ids, cut into pieces no longer than a sequence."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import release_memory, sized_slices
from shelfmark.llm.word_parts import REMEMBERED, Memory, cuts_at_white_space, distinct_words, library_tokenizer, word_parts

CAPACITY = 4096
END = 1
#: Bytes of text that are encoded together; what is made of them takes some thirty times as much.
BATCH = 1 << 20


class TextTokenizer:
    """Ids of whole texts: word by word, each distinct word encoded once, where the tokenizer's file proves that to be the same."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.parts = word_parts(path, remembered) if cuts_at_white_space(path) else None
        self.whole = library_tokenizer(path) if self.parts is None else None
        self.known = Memory(remembered)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if self.parts is None:
            for made in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
                yield np.array(made.ids, dtype="<u4").tobytes()
            return
        self.known.trim()
        known = self.known
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        words, number, per_text = distinct_words(np.frombuffer(b"".join(texts), np.uint8), starts)
        new = [w for w in words if w not in known]
        known.update(zip(new, self.parts.ids(new), strict=True))
        ids = [known[w] for w in words]
        table = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begins = np.cumsum(lengths) - lengths
        # ids of all words one after the other: places in the table, word by word
        own = lengths[number]
        ends = np.cumsum(own)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[number] - (ends - own), own)
        every = table[places]
        running = np.concatenate([[0], ends])
        last = np.cumsum(per_text)
        for a, b in zip(running[last - per_text].tolist(), running[last].tolist(), strict=True):
            yield every[a:b].tobytes()


@cache
def text_tokenizer(path: str, remembered: int = REMEMBERED) -> TextTokenizer:
    """One for each Python worker, which serves many tasks."""
    return TextTokenizer(path, remembered)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ``with_ids`` ids, little-endian 32-bit) of every document's pieces.

    A document is its ids and one ``end`` id; a null text counts as empty, so it is the ``end`` id alone.  Only documents
    longer than ``capacity`` are cut, into full pieces and a rest; no id is lost.  Rows are encoded where they are; a worker
    remembers the ids of ``remembered`` words, which costs it some 200 bytes each.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    last = array("I", [end]).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        words = text_tokenizer(tokenizer, remembered)
        for batch in sized_slices(batches, 1, BATCH):
            rows = []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(texts), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut)[: len(names)])
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, schema)
