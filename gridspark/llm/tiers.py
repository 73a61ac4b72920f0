"""Hierarchical packing into several context sizes.

Tokenising and packing are one map over the texts: ids never move, nothing is shuffled, and no key can be hot. A task
packs ``window_tokens`` tokens at a time, so its memory is bounded by them and the longest text.

In a window a document's whole largest contexts are sequences of their own; what is left of it goes to the tier of the
smallest context that holds it. From the largest tier down, each piece opens a sequence of its tier, and the gap is
filled by the longest pieces that fit, which come from shorter tiers; where none fits, the shortest that is longer
is cut, and its rest goes back to the tier of its new length. So every sequence fills its context, but for the
window's last, which is cut into sequences whose lengths are the powers of two that its length is made of. With tiers
that are powers of two no token of padding is left.

The sequences of a tier are dealt to step groups of ``step_tokens`` tokens: group sizes differ by one sequence at most,
and costly sequences (the sum of the squares of the pieces' lengths, as attention within documents takes) are
dealt first, each to the group of the least cost that has room.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table
from gridspark.llm.packing import default_vocabulary, encoder

#: Context sizes, rising; powers of two, since shorter sequences are not padded at these.
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task packs together.
WINDOW_TOKENS = 4_000_000
#: Tokens of a step group: as many for every tier.
STEP_TOKENS = 16_384

Piece = tuple[int, int, int]  # document, start, length


class Pool:
    """Pieces by their length; a bit for each length that there is finds the nearest one at once."""

    def __init__(self) -> None:
        self._by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self._lengths = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self._by[length].append((doc, start))
        self._lengths |= 1 << length

    def take(self, length: int) -> Piece:
        same = self._by[length]
        doc, start = same.pop()
        if not same:
            self._lengths ^= 1 << length
        return doc, start, length

    def at_most(self, limit: int) -> int:
        """The greatest length up to ``limit``, or 0."""
        return max(0, (self._lengths & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def above(self, limit: int) -> int:
        """The smallest length over ``limit``, or 0."""
        rest = self._lengths >> (limit + 1)
        return limit + (rest & -rest).bit_length() if rest else 0


def pack_tiers(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces (document, start, length); each token of each document lies in one of them."""
    top, pool = tiers[-1], Pool()
    sequences: list[list[Piece]] = []
    for doc, n in enumerate(lengths):
        whole = n - n % top
        sequences += [[(doc, k, top)] for k in range(0, whole, top)]
        if n > whole:
            pool.put(doc, whole, n - whole)
    for shorter, size in reversed(list(zip((0, *tiers), tiers))):
        while (first := pool.at_most(size)) > shorter:
            sequence, gap = [pool.take(first)], size - first
            while gap:
                if fits := pool.at_most(gap):
                    sequence.append(pool.take(fits))
                elif longer := pool.above(gap):
                    doc, start, length = pool.take(longer)
                    sequence.append((doc, start, gap))
                    pool.put(doc, start + gap, length - gap)
                    break
                else:  # the last pieces of all
                    return sequences + powers_of_two(sequence)
                gap -= fits
            sequences.append(sequence)
    return sequences


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces as sequences of falling lengths that are powers of two, cut where one is full."""
    total = sum(n for _, _, n in pieces)
    rest, out = pieces[::-1], []
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        sequence = []
        while size:
            doc, start, length = rest.pop()
            if length > size:
                rest.append((doc, start + size, length - size))
            sequence.append((doc, start, min(length, size)))
            size -= sequence[-1][2]
        out.append(sequence)
    return out


def step_groups(sequences: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence; a group has sequences of one length, ``step_tokens`` tokens of them at most."""
    cost = [sum(n * n for _, _, n in s) for s in sequences]
    of_size: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(sequences):
        of_size[sum(n for _, _, n in s)].append(k)
    groups, first = [0] * len(sequences), 0
    for size, mine in sorted(of_size.items(), reverse=True):
        most = max(1, step_tokens // size)
        count = -(-len(mine) // most)
        room = [len(mine) // count + (g < len(mine) % count) for g in range(count)]
        least = [(0, g) for g in range(count)]
        for k in sorted(mine, key=lambda k: -cost[k]):
            spent, g = heapq.heappop(least)
            groups[k] = first + g
            room[g] -= 1
            if room[g]:
                heapq.heappush(least, (spent + cost[k], g))
        first += count
    return groups


def pack_documents(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    window_tokens: int = WINDOW_TOKENS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of each document's ids, ended by ``end_id``: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, context (the sequence's length), step_id and, with ``with_ids``, ids.

    Null and empty texts are the end id alone; rows that repeat a doc_id are documents of their own, each with its
    own starts; null ids stay null. Texts of any length are taken whole. Other columns are not read, so no name
    clashes. An empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_id"]
    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids

    def packed(docs: list, ids: list[np.ndarray], base: int, step: int) -> tuple[pa.RecordBatch, int, int]:
        """The rows of one window, with sequences numbered from ``base`` and steps from ``step``, and the next numbers."""
        sequences = pack_tiers([len(x) for x in ids], tiers)
        steps = step_groups(sequences, step_tokens)
        rows, parts = [], []
        for k, sequence in enumerate(sequences):
            offset, context = 0, sum(n for _, _, n in sequence)
            for doc, start, length in sequence:
                part = ids[doc][start : start + length]
                rows.append((docs[doc], start, length, zlib.crc32(part.tobytes()), len(ids[doc]), base + k, offset, context, step + steps[k]))
                parts.append(part.astype(np.int32)) if with_ids else None
                offset += length
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + ([pa.array(parts, pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids), base + len(sequences), step + max(steps) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = step = TaskContext.get().partitionId() << 32
        docs: list = []
        ids: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                ids.append(np.append(encode(text.as_py() or ""), end_id).astype("<u4"))
                tokens += len(ids[-1])
                if tokens >= window_tokens:
                    rows, base, step = packed(docs, ids, base, step)
                    docs, ids, tokens = [], [], 0
                    yield rows
        if docs:
            yield packed(docs, ids, base, step)[0]

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
