"""Token packing with the sum-of-squares rule.

Tokenising is one map over the texts, with no shuffle; only (doc_id, piece, length) rows move afterwards.
Pieces are dealt by hash to shards of about ``shard_rows`` rows each, and every shard is packed on its own,
so the work is spread over as many tasks as the corpus needs; a shard leaves about one sequence unfilled.

In a shard, pieces go by falling length. A piece goes to the open bin whose change makes the sum over all
residual gaps g of N(g) squared smallest, N(g) being the number of open bins with gap g; a bin is opened only
where no open one has room, which with falling lengths keeps the sequences as few as best-fit does.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, written

#: The split pattern and the special token of the public byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    The ids are those of ``tokenizers`` for that file; ``tiktoken`` computes them from the same vocabulary
    about five times as fast. A text that it cannot take falls back to ``tokenizers`` itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    special = vocabulary.pop(SPECIAL, len(vocabulary))
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items()}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # a panic, where the library's pattern engine runs out of stack, is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return np.array(plain_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


@lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_bounds(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: one if it fits, else pieces of the capacity, of which the first may be shorter."""
    first = tokens % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, tokens, capacity))] if tokens else []


def token_pieces(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Cuts every document's ids, ended by ``end_id``, into pieces of at most ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, ids. Null and empty texts are
    the end id alone. Only the two named columns are read.
    """
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    made = [doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32)]
                    for column, value in zip(rows, made):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names[: len(rows)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, in the order given; lengths are 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = defaultdict(list)
    at, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        open_bins = count[size:capacity]
        gap = 0
        if len(open_bins) and open_bins.any():
            change = 2 * (count[: capacity - size] - open_bins) + 2
            change[0] = 1 - 2 * open_bins[0]  # a full bin leaves the sum
            gap = size + int(np.argmin(np.where(open_bins > 0, change, np.iinfo(np.int64).max)))
        if gap:
            number = bins[gap].pop()
            count[gap] -= 1
        else:
            number, gap, opened = opened, capacity, opened + 1
        at[k], offset[k] = number, capacity - gap
        if gap > size:
            bins[gap - size].append(number)
            count[gap - size] += 1
    return at, offset


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 8192, rows: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces of a sequence lie gapless from offset 0.

    ``rows``: how many pieces there are, counted if not given; it only sets the number of shards. Pieces of
    equal length go by doc_id, nulls last, then by piece; which of two wholly equal rows comes first makes
    no difference, nor do ids that repeat or are null: a row's own number deals it to its shard. ``length`` must be 1 to
    ``capacity``.
    """
    shards = max(1, -(-(pieces.count() if rows is None else rows) // shard_rows))
    schema = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    names = pieces.columns

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at, offset = sum_of_squares(part["length"].to_numpy(np.int64), capacity)
        return part[names].assign(sequence_id=(int(key[0]) << 32) + at, offset=offset)

    shard = F.pmod(F.xxhash64("_row"), F.lit(shards))
    return pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_shard", shard).drop("_row").groupBy("_shard").applyInPandas(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id, ids, doc_ids. A group is one sequence, so its size is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (
        packed.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; an empty table gives an empty result."""
    pieces = written(token_pieces(docs, capacity, vocabulary, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the placed pieces of all documents.

    Null and empty texts are one token each; rows that repeat a doc_id are documents of their own. Other columns are
    not read, so no name clashes. An empty table gives an empty result.
    """
    return pack_documents(docs)
