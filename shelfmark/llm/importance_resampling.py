"""Importance resampling towards a target: hashed n-gram features, their gains, document weights and a Gumbel top-k draw.

Features are runs of one to three words.  A task finds the distinct features of a batch of texts, lays those of equal length side by
side as a matrix of bytes and updates all their CRC-32 column by column; buckets are scattered back to the occurrences.
Buckets are counted over all documents and all target texts, and a second pass weighs every document by them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import stored, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text that are hashed together; rows of a matrix that are updated at once.
BATCH, ROWS = 4 << 20, 1 << 14
#: Beyond so many bytes a feature is hashed by itself, as one matrix column for each byte would be for a few rows only.
WIDEST = 256


def _crc_steps() -> np.ndarray:
    """The CRC-32 of every byte value, as the step of the remainder."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    return step


STEPS = _crc_steps()
#: Every byte in lower case, and whether it belongs to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def crc32_of_slices(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of ``raw``: slices of one length form a matrix, whose columns update all remainders at once."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges) if len(order) else []:
        length = int(lengths[group[0]])
        if length > WIDEST:
            out[group] = [zlib.crc32(raw[at : at + length]) for at in starts[group].tolist()]
            continue
        column = np.arange(length)[:, None]
        for part in np.array_split(group, -(-len(group) // ROWS)):
            matrix = raw[starts[part] + column]  # a row of it for each byte position, so that columns lie together
            left = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for byte in matrix:
                left = STEPS[(left ^ byte) & 0xFF] ^ (left >> np.uint32(8))
            out[part] = left ^ np.uint32(0xFFFFFFFF)
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of every distinct key, and the key's number at every place."""
    numbered = pa.array(keys).dictionary_encode()
    number = numbered.indices.to_numpy()
    first = np.empty(len(numbered.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, number


def features(raw: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts that lie end to end in ``raw``; ``starts`` also has the end of the last."""
    low = LOWER[raw]
    word = WORD[low]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    borders = starts[:-1][starts[:-1] < len(raw)]
    opens[borders] = word[borders]  # a word ends with its text
    first = np.flatnonzero(opens)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # words one after the other, each followed by one space, so that every feature is a slice
    number = np.cumsum(opens)[word] - 1
    sizes = np.bincount(number, minlength=len(first))
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    line = np.full(int(ends[-1]), 32, np.uint8)
    line[np.arange(len(number)) + number] = low[word]
    row = np.searchsorted(starts, first, side="right") - 1
    del low, word, opens, number

    text = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, ends[-1]).astype(np.int64)), pa.py_buffer(line)]
    )
    words = text.dictionary_encode()
    one = words.indices.to_numpy().astype(np.int64)
    rows, found = [], []
    key = one
    for run in (1, 2, 3):
        if run > 1:
            # the run of the words before, and one word more, in the same text
            key = number_of_run[:-1].astype(np.int64) * len(words.dictionary) + one[run - 1 :]
        same = row[: len(row) - run + 1] == row[run - 1 :]
        place, number_of_run = _distinct(key)
        # a run over the border of two texts is numbered like any other and left out of the result
        bucket = crc32_of_slices(line, begins[place], ends[place + run - 1] - 1 - begins[place]) % buckets
        rows.append(row[: len(same)][same])
        found.append(bucket[number_of_run][same].astype(np.int64))
        if len(one) <= run:
            break
    return np.concatenate(rows), np.concatenate(found)


def _parts(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Texts in parts of about ``BATCH`` bytes: the first row, bytes, starts and the sign with which the features count.

    A longer text is cut between words.  Each part of it begins with the last two words before it, and these two words come
    once more by themselves with sign -1, so that every feature of the whole text counts once.
    """
    at = 0
    while at < len(starts) - 1:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + BATCH, side="right")) - 1)
        here, there = int(starts[at]), int(starts[end])
        if there - here <= BATCH:
            yield at, raw[here:there], starts[at : end + 1] - here, 1
        else:
            yield from ((at, part, np.array([0, len(part)]), sign) for part, sign in _cut(raw[here:there]))
        at = end


def _cut(text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    begin, cut = 0, 0  # of the last two words before the cut
    while cut < len(text):
        if cut:
            yield text[begin:cut], -1
        end = min(len(text), cut + BATCH)
        while end < len(text):  # on to the end of a word, however long
            ahead = np.flatnonzero(~WORD[LOWER[text[end : end + BATCH]]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(len(text), end + BATCH)
        yield text[begin:end], 1
        word = WORD[LOWER[text[begin:end]]]
        word[1:] &= ~word[:-1]
        opens = np.flatnonzero(word)
        begin, cut = begin + (int(opens[-2]) if len(opens) > 1 else 0), end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the features of all ``texts`` (column ``text``); a null text has none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, starts, sign in _parts(*text_bytes(batch.column(0))):
                total += sign * np.bincount(features(raw, starts, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target to its share in the source, both with one more in each bucket."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = [(t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; the sum of the gains of a row's features, none for a null text."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, weight = np.zeros((2, batch.num_rows), np.int64)
            for at, raw, starts, sign in _parts(*text_bytes(batch.column(1))):
                rows, bucket = features(raw, starts, len(gain))
                here = slice(at, at + len(starts) - 1)
                count[here] += sign * np.bincount(rows, minlength=len(starts) - 1)
                # whole numbers far below 2^53, so sums of doubles are exact
                weight[here] += sign * np.bincount(rows, weights=gain[bucket], minlength=len(starts) - 1).astype(np.int64)
            # w words have w + (w - 1) + (w - 2) features
            words = np.where(count > 3, count // 3 + 1, (count + 1) // 2)
            columns = [batch.column(0), pa.array(words), pa.array(count), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a hash of the id between 0 and 1; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; ``rank`` counts the drawn ones from 1 and is null for others.

    Drawn are the floor(percent * N / 100) highest scores of the N rows with at least ``least_words`` words, ties to the smaller
    doc_id (null first; rows that tie in id as well are drawn in any order).  Null and empty texts have no features and weight 0.
    Without target texts all gains follow from the source alone; empty ``docs`` give no rows.

    The counts of all buckets, one row for each, are all that leaves the tasks.  The draw keeps a row group of the ranges of
    a sort by score: sizes of the ranges give each row its rank, so no task holds all drawn rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    order = [(~fit).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # the place in the stored table splits rows that tie in all else over ranges
    ordered = (
        scored.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), fit.alias("fit"),
        )
    )
    ordered = stored(ordered, "ordered_scores")
    sizes = dict(ordered.groupBy("part").agg(F.count(F.lit(1))).collect())  # one row for each range
    starts, start = [], 0
    for part in sorted(sizes):
        starts.append((part, start))
        start += sizes[part]
    starts = docs.sparkSession.createDataFrame(starts, "part int, start long")
    rank = F.col("start") + F.col("at") + 1
    return ordered.join(F.broadcast(starts), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank")
    )
