"""Near-duplicate join on word shingles by the chosen-path method (recursive splits on sampled shared tokens).

Documents with equal shingle sets form one class, so copies are never expanded. A MinHash coordinate picks one
token of a set at random; two sets of Jaccard similarity s pick the same with probability s. Every run splits all
classes by ``branches`` coordinates; buckets above ``leaf_rows`` are split again by further coordinates drawn for
the bucket, level by level. Buckets of one member vanish. Splitting multiplies a bucket's pairs by ``branches`` times
their mean similarity; where that is 1 or more it would only copy the bucket, which is therefore compared as it is. Runs
repeat until the target recall; ``recall`` counts in that deeper levels share a pool of coordinates.

Small buckets are compared whole; larger ones (dense, left at ``levels``, or of more than ``BLOCK_TOKENS`` tokens in few
members) by pairs of blocks, so no task holds more than two blocks and nothing is capped. Both members' exact sets decide; a pair counts only in the first of
their common buckets, so no pairs are emitted: each compared bucket returns, for each member, the number of its
links and one edge of a spanning forest. Components come from those edges by repeated star contraction.

Joins on a bucket broadcast the buckets of over ``rows / MANY`` members, of which there are at most ``MANY``; the
others are shuffled, and none of them is a large share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import broadcast_if_small, free_name, table, written
from gridspark.llm.shingles import coordinates, shingle_set

#: Coordinates from which the levels below the first draw.
POOL = 40
#: Runs beyond which the target recall counts as out of reach.
MOST_RUNS = 64
#: Coordinates, and signs of each, by which a bucket's mean similarity is estimated; they steer the work, not the result.
PROBES, SIGNS = 3, 12
#: Buckets that a join broadcasts at most.
MANY = 20_000
#: Tokens that a block of a bucket holds on average at most, and those that are matched at a time.
BLOCK_TOKENS = 12_000_000
SLICE_TOKENS = 1_000_000


def recall(threshold: float, branches: int, runs: int, levels: int, pool: int = POOL) -> float:
    """Least probability that a pair at the threshold meets in a compared bucket, however deep the splits go.

    Of the pool's coordinates the pair shares a binomial number; given that number, every draw of a lower level
    finds a shared one independently. A pair survives a level with 1 - (1 - share * below)^branches. The first
    level has coordinates of its own for each run.
    """
    shared = np.arange(pool + 1)
    ways = np.array([math.comb(pool, k) for k in shared], float)
    weight = ways * threshold**shared * (1 - threshold) ** (pool - shared)
    below = np.ones(pool + 1)
    for _ in range(levels - 1):
        below = 1 - (1 - shared / pool * below) ** branches
    return float(1 - (weight * (1 - threshold * below) ** (branches * runs)).sum())


def runs_needed(threshold: float, branches: int, target: float, levels: int = 6, pool: int = POOL) -> int:
    """Runs after which a pair at the threshold is found with probability ``target``; an error if MOST_RUNS don't do."""
    for runs in range(1, MOST_RUNS + 1):
        if recall(threshold, branches, runs, levels, pool) >= target:
            return runs
    raise ValueError(f"{MOST_RUNS} runs of {branches} branches don't reach a recall of {target} at a similarity of {threshold}: raise branches")


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, width: int, count: int) -> DataFrame:
    """doc_id, c (128-bit hash of the shingle set; null if it is empty), tokens (its size), sig (MinHash coordinates).

    One map, no shuffle.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                keys.append(set_key(s))
                sizes.append(len(s))
                sigs.append(coordinates(s, count).view(np.int64) if len(s) else None)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "c", "tokens", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, c binary, tokens long, sig array<long>")


def _peopled(rows: DataFrame, level: int, many: int) -> DataFrame:
    """The rows (node, c) of nodes with two members or more, with the node's size."""
    sizes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes{level}")
    told = rows.join(F.broadcast(sizes.where(F.col("size") > many)), "node", "left")
    rest = told.where("size IS NULL").select("node", "c").join(sizes.where(F.col("size") <= many), "node")
    return written(told.where("size IS NOT NULL").unionByName(rest), f"level{level}")


def _on_node(rows: DataFrame, nodes: DataFrame, how: str, many: int) -> DataFrame:
    """``rows`` joined on node; both sides have the node's size, by which the largest nodes are broadcast."""
    large = F.col("size") > many
    told = nodes.drop("size") if how == "inner" else nodes.select("node")
    few, others = (nodes.where(x).select(told.columns) for x in (large, ~large))
    return rows.where(large).join(F.broadcast(few), "node", how).unionByName(rows.where(~large).join(others, "node", how))


def _dense(large: DataFrame, drawn, branches: int) -> DataFrame:
    """(node, size) of the nodes whose members agree in a coordinate with probability 1 / ``branches`` or more.

    That is the sum of the squared shares of the tokens drawn, which the squared sum of random signs of the tokens
    estimates: one sum for each sign, added up where the members lie, and no row for a token.
    """
    sums = []
    for k in range(PROBES):
        bits = F.xxhash64(F.lit(k), F.element_at("sig", drawn(k, 1000)))
        sums += [F.sum(F.lit(1) - F.lit(2) * F.shiftright(bits, j).bitwiseAND(F.lit(1))).cast("double") for j in range(SIGNS)]
    squares = reduce(lambda a, b: a + b, [x * x for x in sums]) / F.lit(float(len(sums)))
    return large.groupBy("node", "size").agg(squares.alias("agree")).where(F.col("agree") * branches >= F.col("size") * F.col("size").cast("double")).drop("agree")


def buckets(classes: DataFrame, branches: int, runs: int, leaf_rows: int, levels: int, many: int) -> DataFrame:
    """The buckets to be compared: (node, c, size)."""
    own = runs * branches  # coordinates of the first level
    first = [F.xxhash64(F.lit(j), F.element_at("sig", j + 1)) for j in range(own)]
    rows = _peopled(classes.select("c", F.explode(F.array(*first)).alias("node")).select("node", "c"), 0, many)
    leaves = []
    for level in range(1, levels + 1):
        leaves.append(rows.where(F.col("size") <= leaf_rows))
        large = rows.where(F.col("size") > leaf_rows)
        if large.isEmpty():
            break
        if level == levels:
            leaves.append(large)
            break
        # the coordinates of one node's branches differ
        drawn = lambda k, salt: F.pmod(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(POOL)) + k, F.lit(POOL)).cast("int") + own + 1
        large = written(large.join(classes.select("c", "sig"), "c"), f"large{level}")
        dense = written(_dense(large, drawn, branches), f"dense{level}")
        leaves.append(_on_node(large, dense, "left_semi", many).select("node", "c", "size"))
        child = [F.xxhash64("node", F.lit(k), F.element_at("sig", drawn(k, 0))) for k in range(branches)]
        split = _on_node(large, dense, "left_anti", many).select("c", F.explode(F.array(*child)).alias("node"))
        rows = _peopled(written(split.select("node", "c"), f"split{level}"), level, many)  # it is read three times
    found = written(reduce(DataFrame.unionByName, [x.select("node", "c", "size") for x in leaves]), "leaves")
    # buckets of the same members are compared once
    content = found.groupBy("node", "size").agg(F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "c")).alias("y"))
    once = written(content.groupBy("size", "x", "y").agg(F.min("node").alias("node")).select("node", "size"), "once")
    return written(_on_node(found, once, "left_semi", many), "buckets")


class _Bucket:
    """Members of one compared bucket, or of two of its blocks."""

    def __init__(self, key: tuple):
        self.key, self.names, self.sets, self.paths, self.blocks = key, [], [], [], []

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token, member) of the tokens in ranges of their values, of about SLICE_TOKENS each; sets rise."""
        parts = 1 << max(0, (sum(map(len, self.sets)) // SLICE_TOKENS).bit_length())
        edges = [np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)) for s in self.sets] if parts > 1 else None
        for k in range(parts):
            cut = self.sets if edges is None else [s[e[k - 1] if k else 0 : e[k] if k < parts - 1 else len(s)] for s, e in zip(self.sets, edges)]
            yield np.concatenate(cut), np.repeat(np.arange(len(cut), dtype=np.int32), [len(s) for s in cut])

    def links(self, threshold: float) -> np.ndarray:
        """Boolean matrix of the pairs at the threshold that have no earlier bucket in common."""
        n = len(self.sets)
        sizes = np.array([len(s) for s in self.sets])
        shared = np.zeros((n, n), np.float32)
        for token, where in self.slices():
            order = np.argsort(token, kind="stable")
            token, where = token[order], where[order]
            column = np.cumsum(np.append(True, token[1:] != token[:-1])[: len(token)]) - 1
            often = np.bincount(column) > 1
            column, where = (np.cumsum(often) - 1)[column[often[column]]], where[often[column]]
            for low in range(0, int(often.sum()), 4096):
                a, b = np.searchsorted(column, [low, low + 4096])
                part = np.zeros((n, 4096), np.float32)
                part[where[a:b], column[a:b] - low] = 1
                shared += part @ part.T
        union = sizes[:, None] + sizes[None, :] - shared
        close = shared >= threshold * union - 1e-6
        earlier = sorted({p for path in self.paths for p in path if p < self.key[0]})
        if earlier:
            number = {p: k for k, p in enumerate(earlier)}
            on = np.zeros((n, len(earlier)), np.float32)
            for k, path in enumerate(self.paths):
                on[k, [number[p] for p in path if p in number]] = 1
            close &= (on @ on.T) == 0
        blocks = np.array(self.blocks)
        if self.key[1] != self.key[2]:  # pairs inside a block belong to the block's own comparison
            close &= blocks[:, None] != blocks[None, :]
        np.fill_diagonal(close, False)
        return close

    def rows(self, threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
        """(member, a member it is linked with through this bucket, number of links); linked members only."""
        close = self.links(threshold)
        counts = close.sum(1)
        root = np.full(len(counts), -1)
        for start in np.flatnonzero(counts):
            if root[start] < 0:
                root[start], front = start, [start]
                while front:
                    near = np.flatnonzero(close[front.pop()] & (root < 0))
                    root[near] = start
                    front += near.tolist()
        for k in np.flatnonzero(counts):
            yield self.names[k], self.names[root[k]], int(counts[k])


def compare(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) from rows (node, bi, bj, block, c, tokens, path), of which a bucket's rows stand together."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, out = None, []

        def close() -> None:
            if bucket is not None and len(bucket.names) > 1:
                out.extend(bucket.rows(threshold))

        def flush() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.binary(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["a", "b", "links"])
            out.clear()
            return batch

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for k, key in enumerate(keys):
                if bucket is None or key != bucket.key:
                    close()
                    bucket = _Bucket(key)
                name = batch.column(4)[k].as_py()
                if bucket.names and name == bucket.names[-1] and bucket.blocks[-1] == batch.column(3)[k].as_py():
                    continue  # a repeated row
                bucket.names.append(name)
                bucket.blocks.append(batch.column(3)[k].as_py())
                bucket.sets.append(np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64))
                bucket.paths.append(batch.column(6)[k].as_py())
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return members.mapInArrow(verify, "a binary, b binary, links long")


def components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), root the smallest node of its component.

    Large-star and small-star contraction until every node but the roots has one edge, to its root; each round is two tables
    and two of nodes, and the driver sees two counts of it. Nodes with over 1 of ``many`` edges, of which there are at most
    twice as many, meet their edges by a broadcast, so the centre of a large component is no key of a shuffle.
    """

    def lowest(e: DataFrame) -> DataFrame:
        """(a, m, n): each a's smallest b, or a itself if that is smaller, and the number of its rows."""
        return written(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m")), "low")

    def star(e: DataFrame, low: DataFrame, count: int) -> DataFrame:
        """The rows (a, b) with a's smallest, m."""
        often = F.col("n") * many > 2 * count
        told = e.join(F.broadcast(low.where(often).select("a", "m")), "a", "left")
        return told.where("m IS NOT NULL").unionByName(told.where("m IS NULL").drop("m").join(low.where(~often).select("a", "m"), "a"))

    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(turned, "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both)
        open_nodes, ends = low.agg(F.count_if(F.expr("m < a AND n > 1")), F.sum("n")).first()
        if not open_nodes:  # stars already, so each node's smallest is its root
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = star(both, low, ends // 2).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        half = written(large.where("a <> b"), "half")
        low = lowest(half)
        small = star(half, low, ends // 2).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        now = written(small.distinct(), "stars")


def class_names(told: DataFrame, many: int = MANY) -> DataFrame:
    """``told`` (root, set_id and others) with class_id, the smallest set_id that shares its root; null where root is.

    Roots of over 1 of ``many`` rows are broadcast; the others are shuffled, and none of them is a large share.
    """
    groups = told.where("root IS NOT NULL").groupBy("root").agg(F.min("set_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    names = written(groups, "names")
    often = F.col("n") * many > F.lit(names.agg(F.sum("n")).first()[0] or 0)
    few, others = (names.where(x).select("root", "class_id") for x in (often, ~often))
    apart = told.join(F.broadcast(few.withColumn("named", F.lit(True))), "root", "left")
    rest = apart.where("root IS NOT NULL AND named IS NULL").drop("class_id", "named").join(others, "root")
    return apart.where("root IS NULL OR named").drop("named").unionByName(rest)


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    target: float = 0.9999,
    branches: int = 2,
    leaf_rows: int = 256,
    block_rows: int = 768,
    levels: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, set_id, n_links, kept.

    set_id is the smallest doc_id with the same set of ``width``-word shingles; n_links is the number of other
    sets whose Jaccard similarity with this one is ``threshold`` or more; class_id is the smallest doc_id of all
    documents that such links connect, and ``kept`` says whether that is this row's doc_id. Null texts and those
    without words have an empty set, which is like no other: they are classes of their own, without links.
    Rows that repeat a doc_id share what their texts give; null ids are kept as they are. Only the two named
    columns are read. An empty table gives an empty result.
    """
    runs = runs_needed(threshold, branches, target, levels)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(sketches(docs, width, runs * branches + POOL), "sketches")
    classes = written(
        found.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("set_id"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig")), "classes"
    )
    many = max(leaf_rows, classes.count() * runs * branches // MANY)  # larger buckets are fewer than MANY
    leaves = buckets(classes, branches, runs, leaf_rows, levels, many)
    paths = written(
        leaves.groupBy("c").agg(F.collect_list("node").alias("path")).join(classes.select("c", "set_id", "tokens"), "c"), "paths"
    )

    # the exact sets of those that share a bucket, read from one document of each class
    again = broadcast_if_small(paths.select(F.col("set_id").alias("_id")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            keys = pa.array([set_key(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "tokens"])

    texts = docs.join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    tokens = texts.mapInArrow(sets, "c binary, tokens binary").join(paths.select("c", "path"), "c")

    # a small bucket is one block, unless large members call for more; a large one, as many as members and tokens call for
    small = leaves.where(F.col("size") <= leaf_rows).select("node", "c")
    big = classes.where(F.col("tokens") > BLOCK_TOKENS // leaf_rows).select("c", F.col("tokens").alias("weight"))  # without them it is bounded
    heavy = small.join(broadcast_if_small(big), "c").groupBy("node").agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).cast("int").alias("parts"))
    heavy = written(heavy.where("parts > 1"), "heavy")
    small = small.join(broadcast_if_small(heavy), "node", "left").select("node", "c", F.coalesce("parts", F.lit(1)).alias("parts"))
    large = leaves.where(F.col("size") > leaf_rows).join(paths.select("c", F.col("tokens").alias("weight")), "c")
    parts = F.ceil(F.greatest(F.col("size") / block_rows, F.sum("weight") / BLOCK_TOKENS)).cast("int")
    counted = written(large.groupBy("node", "size").agg(parts.alias("parts")), "parts")
    blocks = small.unionByName(_on_node(large.select("node", "c", "size"), counted, "inner", many).select("node", "c", "parts"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("c", F.lit(3)), F.col("parts")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select(
        "node", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "c"
    )
    members = (
        blocks.join(tokens, "c")
        .select("node", "bi", "bj", "block", "c", "tokens", "path")
        .repartition("node", "bi", "bj")
        .sortWithinPartitions("node", "bi", "bj", "c")
    )
    links = written(compare(members, threshold), "links")
    # for each class its number of links and the root of its component, gathered in one shuffle
    roots = components(links.select("a", "b"))
    none = {"set_id": F.lit(None).cast("long"), "root": F.lit(None).cast("binary"), "links": F.lit(0).cast("long")}
    sides = [classes.select("c", "set_id"), roots.select(F.col("node").alias("c"), "root"), links.select(F.col("a").alias("c"), "links")]
    sides = [x.withColumns({k: v for k, v in none.items() if k not in x.columns}) for x in sides]
    gathered = reduce(DataFrame.unionByName, sides).groupBy("c")
    told = written(gathered.agg(F.max("set_id").alias("set_id"), F.max("root").alias("root"), F.sum("links").alias("n_links")), "told")
    labelled = class_names(told).select("c", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), "n_links")
    return found.select("doc_id", "c").join(labelled, "c", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies, the document with the smallest doc_id stays.

    Rows that share a doc_id are one document here; it goes only if none of its rows stays. Rows without a doc_id,
    or with a null or empty text, stay. Columns of any name come back as they are; an empty table gives none.
    """
    found = jaccard_join(docs)
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    gone = free_name(docs, "gone")
    dropped = written(ids.select(F.col("doc_id").alias(gone)), "dropped")
    return docs.join(broadcast_if_small(dropped), F.col("doc_id") == F.col(gone), "left_anti")
