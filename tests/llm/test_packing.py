import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import packing

ODD = [None, "", " ", "a", "naïve — Straße\r\n\t\t x", "<|endoftext|> plain", "x" * 5000, "word " * 3000, " " * 900, "\U0001f600é"]


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_bins_hold_and_are_gapless(lengths):
    lengths = np.array(lengths, np.int64)
    at, offset = packing.sum_of_squares(lengths, 64)
    for b in set(at.tolist()):
        mine = sorted((o, n) for o, n, a in zip(offset.tolist(), lengths.tolist(), at.tolist()) if a == b)
        end = 0
        for o, n in mine:
            assert o == end
            end += n
        assert end <= 64


def test_each_choice_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(5)
    lengths, cap = rng.integers(1, 30, 120), 30
    at, offset = packing.sum_of_squares(lengths, cap)
    gaps: dict[int, int] = {}
    for size, number in zip(lengths.tolist(), at.tolist()):
        def total(chosen):
            after = gaps | {chosen: gaps[chosen] - size}
            n = np.bincount([g for g in after.values() if g], minlength=cap + 1)
            return int((n**2).sum())
        room = [b for b, g in gaps.items() if g >= size]
        if number in gaps:
            assert total(number) == min(map(total, room))
        else:
            assert not room
            gaps[number] = cap
        gaps[number] -= size


def test_pieces():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(3, 4) == [(0, 3)]


def test_round_trip_and_ids(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(ODD)] + [(3, "a", "x", 1)], "doc_id long, text string, piece string, length int")
    own = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack_documents(docs, 64, with_ids=True).collect()
    want = {k: [*own.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(ODD)}
    for k, ids in want.items():
        mine = sorted((r.piece, r.start, r.length, r.ids, r.ids_crc32) for r in rows if r.doc_id == k)
        got = [x for r in mine for x in r[3]]
        assert got == ids * (2 if k == 3 else 1) or k == 3 and got == ids + ids
        assert all(zlib.crc32(np.array(r[3], "<u4").tobytes()) == r[4] and len(r[3]) == r[2] for r in mine)
        assert all(r[2] == 64 for r in mine if r[0])
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack_documents(docs, 64, with_ids=True)).collect()}
    assert all(len(r.ids) <= 64 for r in whole.values())
    assert sum(len(r.ids) for r in whole.values()) == sum(r.length for r in rows)


def test_few_sequences_and_empty_table(spark):
    rng = np.random.default_rng(1)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 2049, 3000))], "doc_id long, piece int, length long")
    packed = packing.pack(pieces, shard_rows=1500)
    total, used = sum(r.length for r in packed.collect()), packed.select("sequence_id").distinct().count()
    assert used <= 1.03 * total / 2048 + 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_public_file_is_the_default():
    pytest.importorskip("public_tokenizers")
    assert packing.default_vocabulary().endswith("byte_bpe_50k.json")


def test_only_a_panic_falls_back(monkeypatch):
    import tiktoken

    class PanicException(BaseException):
        pass

    path = packing.default_vocabulary()
    whole = Tokenizer.from_file(path)
    for error, falls_back in ((PanicException, True), (MemoryError, False), (KeyboardInterrupt, False)):
        def fail(*_, error=error, **__):
            raise error
        monkeypatch.setattr(tiktoken.Encoding, "encode_to_numpy", fail)
        packing.encoder.cache_clear()
        if falls_back:
            assert packing.encoder(path)("naïve text").tolist() == whole.encode("naïve text", add_special_tokens=False).ids
        else:
            with pytest.raises(error):
                packing.encoder(path)("naïve text")
    packing.encoder.cache_clear()


def test_repeated_and_null_ids_share_no_shard(spark):
    """100,000 pieces without an id and as many of one id: no shard holds twice the mean."""
    rows = spark.range(200_000).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "0 AS piece", "0L AS start", "1 + id % 900 AS length", "5L AS ids_crc32")
    got = packing.pack(rows, 2048, rows=200_000)
    sizes = [r["count"] for r in got.groupBy((packing.F.col("sequence_id") / (1 << 32)).cast("int")).count().collect()]
    assert len(sizes) == 25 and max(sizes) <= 2 * sum(sizes) / len(sizes) and sum(sizes) == 200_000
