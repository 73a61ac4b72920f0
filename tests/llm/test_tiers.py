import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import packing, tiers

ODD = [None, "", " ", "a", "naïve — Straße\r\n\t\t x", "<|endoftext|> plain", "x" * 5000, "word " * 3000, " " * 900, "\U0001f600é"]


def covered(lengths, sequences):
    """Each token of each document lies in exactly one piece."""
    pieces = defaultdict(list)
    for sequence in sequences:
        for doc, start, length in sequence:
            assert length > 0
            pieces[doc].append((start, length))
    for doc, n in enumerate(lengths):
        end = 0
        for start, length in sorted(pieces[doc]):
            assert start == end
            end += length
        assert end == n


@given(st.lists(st.integers(1, 200), max_size=150))
@settings(max_examples=150, deadline=None)
def test_no_padding_and_every_token_once(lengths):
    sequences = tiers.pack_tiers(lengths, (8, 16, 32, 64))
    covered(lengths, sequences)
    sizes = [sum(n for _, _, n in s) for s in sequences]
    assert all(n & (n - 1) == 0 and n <= 64 for n in sizes)
    assert sum(n < 8 for n in sizes) <= 3  # the last sequence alone is cut to powers of two


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049] * 7, [1500] * 40, [1] * 5000, [255, 256, 257], [100_000], [1025] * 64 + [3] * 9])
def test_edges(lengths):
    sequences = tiers.pack_tiers(lengths)
    covered(lengths, sequences)
    assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 and n <= 2048 for s in sequences)


def test_documents_stay_whole_where_they_fit():
    lengths = [1 + (k * 7919) % 2000 for k in range(4000)]
    sequences = tiers.pack_tiers(lengths)
    covered(lengths, sequences)
    pieces = sum(map(len, sequences))
    assert pieces - len(lengths) <= len(sequences)  # a sequence cuts one document at most
    openers = [s[0][2] for s in sequences if sum(p[2] for p in s) == 2048]
    assert min(openers) > 1024  # long windows are opened by long documents and filled by shorter tiers


@given(st.lists(st.integers(1, 90), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_step_groups_are_even(lengths):
    sequences = tiers.pack_tiers(lengths, (8, 16, 32))
    groups = tiers.step_groups(sequences, 64)
    held = defaultdict(list)
    for sequence, g in zip(sequences, groups):
        held[g].append(sum(n for _, _, n in sequence))
    assert sorted(held) == list(range(len(held)))
    counts = defaultdict(list)
    for sizes in held.values():
        assert len(set(sizes)) == 1 and sum(sizes) <= 64
        counts[sizes[0]].append(len(sizes))
    assert all(max(c) - min(c) <= 1 for c in counts.values())


def test_costly_sequences_are_spread():
    sequences = [[(k, 0, 64)] for k in range(4)] + [[(9, j, 1) for j in range(64)] for _ in range(4)]
    groups = tiers.step_groups(sequences, 256)
    assert sorted(groups[:4]) == [0, 0, 1, 1]


def test_round_trip_and_ids(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(ODD)] + [(3, "a", "x", 1), (None, "b c", "y", 2)], "doc_id long, text string, start string, length int")
    own = Tokenizer.from_file(packing.default_vocabulary())
    rows = tiers.pack_documents(docs.repartition(3), (16, 32, 64), window_tokens=1000, with_ids=True).collect()
    want = {k: [*own.encode(t or "", add_special_tokens=False).ids, 1] for k, t in [*enumerate(ODD), (None, "b c")]}
    for k, ids in want.items():
        mine = sorted((r.start, r.length, r.ids, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == k)
        assert sum(([x[2]] for x in mine), []) and {x[4] for x in mine} == {len(ids)}
        for start, length, got, crc, _ in mine:
            assert got == ids[start : start + length]
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in got))
        assert sum(x[1] for x in mine) == len(ids) * (2 if k == 3 else 1)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length, r.context, r.step_id))
    for mine in placed.values():
        end = 0
        for offset, length, _, _ in sorted(mine):
            assert offset == end
            end += length
        assert {(c, s) for _, _, c, s in mine} == {(end, mine[0][3])} and end & (end - 1) == 0 and end <= 64
    found = {r.sequence_id: r.ids for r in packing.sequences(tiers.pack_documents(docs.coalesce(1), (16, 32, 64), with_ids=True)).collect()}
    assert sum(map(len, found.values())) == sum(len(x) * (2 if k == 3 else 1) for k, x in want.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tiers.pack_documents(docs).collect() == []


def test_query(spark):
    got = tiers.query(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)
