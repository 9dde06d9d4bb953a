import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import feistel_shards, swap_packing, token_packing
from shelfmark.llm.queries import tokenizer
from shelfmark.llm.token_pieces import TextTokenizer, pieces


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return tokenizer()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100, 1000])
def test_the_permutation_is_one_and_has_an_inverse(spark, n):
    rows = feistel_shards.permute(spark.range(n), "id", "to", n, 5)
    rows = feistel_shards.permute(rows, "to", "back", n, 5, forward=False).collect()
    assert sorted(r["to"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = feistel_shards.shard_rows(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    texts = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    want = Counter()
    for (doc_id, text), n in texts.items():
        raw = (text or "").encode()
        want[(doc_id, len(raw) + 1, zlib.crc32(raw))] += n
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    again = feistel_shards.shard_rows(odd_docs.repartition(5), 4).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["shard"], r["slot"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    assert feistel_shards.shard_rows(no_docs, 4).collect() == []


def test_the_row_at_a_place(spark, odd_docs):
    placed = feistel_shards.shard_rows(odd_docs, 8).select("shard", "slot", F.col("row").alias("want"))
    found = feistel_shards.rows_at(placed, odd_docs.count(), 8).collect()
    assert all(r["row"] == r["want"] for r in found)


def fewest(lengths, capacity):
    """Fewest bins, by dynamic programming over subsets."""
    best = [(99, 0)] * (1 << len(lengths))
    best[0] = (0, capacity)
    for taken in range(1 << len(lengths)):
        for i, size in enumerate(lengths):
            if not taken >> i & 1:
                bins, used = best[taken]
                new = (bins, used + size) if used + size <= capacity else (bins + 1, size)
                best[taken | 1 << i] = min(best[taken | 1 << i], new)
    return best[-1][0]


def test_packers_are_right_and_near_the_best():
    rnd, excess = random.Random(4), [0, 0]
    for _ in range(60):
        lengths = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 9))]
        for k, bins in enumerate((swap_packing.pack(np.array(lengths), 100), token_packing.best_fit_decreasing(lengths, 100))):
            assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
            excess[k] += len(bins) - fewest(lengths, 100)
    assert excess[0] <= excess[1] <= 3


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4])
    assert len(swap_packing.local_search([[0], [1], [2], [3]], lengths, 10)) == 2
    # one for one: 6+3 | 5+4+1 -> 6+4 | 5+3+1 leaves room for what the third holds
    lengths = np.array([6, 3, 5, 4, 1, 1])
    assert len(swap_packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)) == 2


def test_the_capacity_tree_finds_the_least_room():
    rnd, tree, rooms = random.Random(1), token_packing.CapacityTree(50), []
    for _ in range(300):
        if rooms and rnd.random() < 0.4:
            room = rooms.pop(rnd.randrange(len(rooms)))
            tree.add(room, -1)
        else:
            rooms.append(rnd.randint(0, 50))
            tree.add(rooms[-1], 1)
        want = rnd.randint(1, 50)
        assert tree.least(want) == min((r for r in rooms if r >= want), default=None)


def test_words_encode_like_texts(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    texts = [
        "", "   ", "\x01 a\x01b \x01", "don't I'll it's 'tis", "x<|endoftext|>y <|startoftext|>", "e ́x Ǆ İstanbul ß",
        "a\xa0b\x85c\x1cd \x1f e", "12 3.4%$ ​ z\n\tok", "THE!! the!! The, the", "漢字 かな", "µ ª º É éÉ",
    ]
    words = TextTokenizer(path)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in words.encode([t.encode() for t in texts])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def ids_of(path, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return [(r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]


def test_pieces_lose_nothing(path, odd_docs, no_docs):
    rows = pieces(odd_docs, path, 100, with_ids=True).collect()
    want = Counter()
    for doc_id, ids in ids_of(path, odd_docs):
        for piece, at in enumerate(range(0, len(ids), 100)):
            want[(doc_id, piece, at, tuple(ids[at : at + 100]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    assert all(r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert pieces(no_docs, path).collect() == []


@pytest.mark.parametrize("group", [10, 10_000])
def test_packed_documents(path, odd_docs, no_docs, monkeypatch, group):
    monkeypatch.setattr(swap_packing, "GROUP", group)
    rows = swap_packing.pack_documents(odd_docs, path, 1000).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for members in by_sequence.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == np.cumsum([0] + [r["length"] for r in members])[:-1].tolist()
        assert sum(r["length"] for r in members) <= 1000
    total = sum(r["length"] for r in rows)
    assert total == sum(len(ids) for _, ids in ids_of(path, odd_docs))
    assert len(by_sequence) <= -(-total // 1000) + (2 if group > 10 else 12)
    assert swap_packing.pack_documents(no_docs, path).collect() == []


def test_matrices_unpack_to_the_documents(path, odd_docs, no_docs, tmp_path):
    packed = token_packing.packed_matrices(odd_docs, path, 512)
    for r in packed.collect():
        assert len(r["ids"]) == 4 * 512 and r["cumulative_lengths"][-1] == r["length"] <= 512
        assert r["position_resets"] == r["cumulative_lengths"][:-1]
        assert set(np.frombuffer(r["ids"], "<u4")[r["length"] :].tolist()) <= {0}
    got = Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in token_packing.unpacked(packed).collect())
    want = Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in pieces(odd_docs, path, 512, with_ids=True).collect())
    assert got == want
    assert token_packing.packed_matrices(no_docs, path).collect() == []
    token_packing.write_matrices(odd_docs, str(tmp_path / "m"), path, 512)
    assert odd_docs.sparkSession.read.parquet(str(tmp_path / "m")).count() == packed.count()


def test_texts_are_encoded_in_slices_of_bytes(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from shelfmark.llm.base import sized_slices

    texts = ["ab" * 30, None, "", "c" * 500, "dd", "é" * 45, "f" * 99, "g" * 101]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    for given in ([batch], [batch.slice(1, 6), batch.slice(7)], [batch.slice(0, 0)]):
        cut = list(sized_slices(iter(given), 1, 100))
        assert [r for b in cut for r in b.to_pylist()] == [r for b in given for r in b.to_pylist()]
        for b in cut:
            assert b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 100


def test_memory_of_earlier_stages_goes_back_to_the_system():
    import gc
    import sys

    import numpy as np
    import pytest

    from shelfmark.llm.base import release_memory

    if not sys.platform.startswith("linux"):
        pytest.skip("reads /proc")
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    held = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces that the C library keeps when they are freed
    last = held[::200]
    del held
    gc.collect()
    before = resident()
    release_memory()
    assert resident() < before - (64 << 20) and len(last) == 20
