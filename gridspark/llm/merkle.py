"""A Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for each document.

1. Leaves are digests of whole rows, made by one map with Spark's own functions and kept as a table; texts go no
   further. A range exchange by (source, doc_id) and a count of its parts give every leaf its place in its tree.
2. Leaves are dealt to superblocks of FAN ** ``depth`` places, which are whole subtrees. Each superblock is reduced on its own;
   superblocks of longer trees are then reduced in the same way, and the trees' roots with each other.
3. On the way down every superblock is cogrouped with the outer nodes that its proofs need (the siblings above it),
   finishes its own levels, joins proofs and folds them, together in one task.

A source may hold any share of the rows: its leaves lie in as many superblocks as they need. Small sources share a unit
of work: a unit is the superblocks that begin within as many places of the global order, so it has under twice as
many nodes.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import broadcast_if_small, held_out, table, written

FAN = 16
#: Levels of a superblock; it has FAN ** DEPTH leaves.
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one part of the range exchange.
PART_ROWS = 250_000


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, digests as hex text, one after the other."""
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


# -- places -----------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str], count: int, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The table ``rows``, of ``count`` rows, with ``g``: dense numbers from 0 by ``order`` (ascending, nulls first).

    A range exchange deals and sorts the rows; they are written, so that their places hold, and the parts' sizes (a
    number for each part) give the parts' offsets. ``order`` should tell all rows apart, else one value is one part.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(max(1, -(-count // part_rows)), *keys).sortWithinPartitions(*keys)
    places = F.monotonically_increasing_id()  # the part in the upper 31 bits, the row in the lower 33
    kept = written(dealt.withColumn("_at", places), name)
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    found = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = kept.join(F.broadcast(found), part == F.col("_part"))
    return joined.withColumn("g", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def unit(size: int) -> Column:
    """The unit of work of a node: where its superblock of ``size`` places begins in the global order, by ``size``."""
    return F.floor((F.col("start") + F.col("pos") - F.col("pos") % size) / size)


# -- inside a unit ----------------------------------------------------------------------------------------------


def rounds(n: int, depth: int) -> int:
    """Levels that a superblock of a tree of n nodes reduces."""
    levels = 0
    while n > 1 and levels < depth:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(leaves: list[str], levels: int) -> list[list[str]]:
    """All levels above ``leaves``, which are consecutive and begin at a superblock's first place."""
    out = [leaves]
    for _ in range(levels):
        out.append([digest(*out[-1][k : k + FAN]) for k in range(0, len(out[-1]), FAN)])
    return out


def siblings(level: list[str], k: int) -> tuple[str, str]:
    """The digests of a run left and right of its node k."""
    low = k - k % FAN
    return "".join(level[low:k]), "".join(level[k + 1 : low + FAN])


def superblocks(part: pd.DataFrame, size: int) -> Iterator[tuple[int, int, int, int, pd.DataFrame]]:
    """(tree, start, n, number, nodes by place) of every superblock of a unit."""
    part = part.assign(block=part["pos"] // size).sort_values(["tree", "pos"], kind="stable")
    for (tree, block), nodes in part.groupby(["tree", "block"], sort=False):
        yield int(tree), int(nodes["start"].iloc[0]), int(nodes["n"].iloc[0]), int(block), nodes


def roots(nodes: DataFrame, depth: int) -> DataFrame:
    """The root of every superblock, as a node of the next stage: tree, start, n, pos, digest.

    With a place more for each tree before, trees don't overlap in the next stage's order either.
    """

    size = FAN**depth

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (tree, start // size + tree, -(-n // size), block, reduced(mine["digest"].tolist(), rounds(n, depth))[-1][0])
            for tree, start, n, block, mine in superblocks(part, size)
        ]
        return pd.DataFrame(rows, columns=["tree", "start", "n", "pos", "digest"])

    made = nodes.select("unit", "tree", "start", "n", "pos", "digest").groupBy("unit")
    return made.applyInPandas(reduce, "tree long, start long, n long, pos long, digest string")


def _outer(found: pd.DataFrame) -> dict[tuple[int, int], tuple[list, list]]:
    """What superblocks need from outside: the siblings left and right of each and of the nodes above it, upwards."""
    return {(int(t), int(b)): (list(x), list(y)) for t, b, x, y in zip(found["tree"], found["block"], found["left"], found["right"])}


def paths(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """Of every node the siblings up to the root: tree, pos, left, right."""

    def extend(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        above, rows = _outer(found), []
        for tree, _, n, block, mine in superblocks(part, FAN**depth):
            levels = reduced(mine["digest"].tolist(), rounds(n, depth))
            for k, pos in enumerate(mine["pos"]):
                steps = [siblings(level, k // FAN**t) for t, level in enumerate(levels[:-1])]
                left, right = above[tree, block]
                rows.append((tree, pos, [x for x, _ in steps] + left, [y for _, y in steps] + right))
        return pd.DataFrame(rows, columns=["tree", "pos", "left", "right"])

    return nodes.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(extend, "tree long, pos long, left array<string>, right array<string>")


def proofs(leaves: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The manifest's rows, of leaves (doc_id, tampered and a node's columns) and outer nodes with subroot and root."""

    def finish(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        above, rows = _outer(found), []
        told = {int(t): (s, r) for t, s, r in zip(found["tree"], found["subroot"], found["root"])}
        for tree, _, n, block, mine in superblocks(part, FAN**depth):
            levels = reduced(mine["digest"].tolist(), rounds(n, depth))
            sides = [[siblings(level, k) for k in range(len(level))] for level in levels[:-1]]
            outside = list(zip(*above[tree, block]))
            (subroot, root), further = told[tree], "".join(x + y for x, y in outside)
            for k, (doc, leaf, tampered) in enumerate(zip(mine["doc_id"], mine["digest"], mine["tampered"])):
                steps = [side[k // FAN**t] for t, side in enumerate(sides)]
                node = tampered or leaf
                for x, y in (*steps, *outside):
                    node = digest(x, node, y)
                rows.append((doc, leaf, subroot, root, digest(*(x + y for x, y in steps), further), node, node == root))
        return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    made = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null among its integers
    made = made.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(finish, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


# -- the forest -------------------------------------------------------------------------------------------------


def stages(nodes: DataFrame, longest: int, depth: int, name: str) -> list[DataFrame]:
    """``nodes`` and the superblock roots above them, until every tree has one: the last holds the trees' roots."""
    out = [nodes]
    while len(out) == 1 or longest > 1:
        longest = -(-longest // FAN**depth)
        out.append(written(roots(out[-1], depth), name).withColumn("unit", unit(FAN**depth)))
    return out


def outer_nodes(path: DataFrame, stage: DataFrame, size: int, *extra) -> DataFrame:
    """Paths of the superblock roots (tree, pos) above ``stage`` as that stage's outer nodes."""
    begin = stage.where("pos = 0").select("tree", "start")
    at = F.floor((F.col("start") + F.col("pos") * size) / size).alias("unit")
    return path.join(broadcast_if_small(begin), "tree").select(at, "tree", F.col("pos").alias("block"), "left", "right", *extra)


def manifest(leaves: DataFrame, depth: int = DEPTH, part_rows: int = PART_ROWS) -> DataFrame:
    """The manifest of leaves (doc_id, source, leaf, tampered or null): doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified.

    Leaves of a source go by doc_id, null ids first; rows that repeat an id go by their digests, and wholly equal rows
    are leaves of their own. Null is a source like others, and the first. An empty table gives an empty result.
    """
    rows, size = leaves.count(), FAN**depth
    if not rows:
        empty = leaves.select("doc_id", "leaf").where("false")
        text = [F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")]
        return empty.select("doc_id", "leaf", *text, F.lit(False).alias("verified"))
    told = leaves.withColumn("_row", F.monotonically_increasing_id())  # wholly equal rows need not share a part
    placed = numbered(told, ["source", "doc_id", "leaf", "_row"], rows, "placed", part_rows)
    sources = written(placed.groupBy("source").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "sources")
    found = sources.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("longest")).first()
    trees = numbered(sources, ["source"], found["trees"], "trees", part_rows).withColumnRenamed("g", "tree")
    named = trees.select(F.col("source").alias("_source"), "start", "n", "tree")
    nodes = placed.join(broadcast_if_small(named), F.col("source").eqNullSafe(F.col("_source")))
    nodes = nodes.withColumn("pos", F.col("g") - F.col("start")).withColumn("unit", unit(size))
    nodes = nodes.select("doc_id", "tampered", "unit", "tree", "start", "n", "pos", F.col("leaf").alias("digest"))
    nodes = written(nodes, "nodes")

    source_stages = stages(nodes, found["longest"], depth, "source-roots")
    # the trees' roots, in the order of their sources, are the nodes of one more tree
    first = F.lit(0).cast("long")
    subroots = source_stages[-1].select(first.alias("tree"), first.alias("start"), F.lit(found["trees"]).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    top_stages = stages(subroots.withColumn("unit", unit(size)), found["trees"], depth, "top-roots")
    root = top_stages[-1].first()["digest"]

    # downwards: the root needs nothing from outside; a source's path is that of its subroot
    none = F.array().cast("array<string>")
    path = top_stages[-1].select("tree", "pos", none.alias("left"), none.alias("right"))
    for stage in reversed(top_stages[:-1]):
        path = written(paths(stage, outer_nodes(path, stage, size), depth), "top-paths")
    path = path.select(F.col("pos").alias("tree"), first.alias("pos"), "left", "right")
    for stage in reversed(source_stages[1:-1]):
        path = written(paths(stage, outer_nodes(path, stage, size), depth), "source-paths")
    known = source_stages[-1].select("tree", F.col("digest").alias("subroot"))
    path = path.join(broadcast_if_small(known), "tree")
    return proofs(nodes, outer_nodes(path, nodes, size, "subroot", F.lit(root).alias("root")), depth)


def leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A digest of each row's ``fields`` and, where ``tampered`` holds, that of the row with its text's A-Z in lower case.

    Only these columns are read. Null and empty values differ; texts are taken whole.
    """
    values = [F.col(c) for c in fields]
    changed = [lowered(F.col(c)) if c == text_col else F.col(c) for c in fields]
    made = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), row_digest(values).alias("leaf"), F.when(tampered, row_digest(changed)).alias("tampered")
    )
    return written(made, "leaves")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)))


# -- SQL --------------------------------------------------------------------------------------------------------

#: Levels that the SQL reckons with, of each source's tree and of the one over the sources: 16 ** 8 nodes.
_LEVELS = 8


def _oracle() -> str:
    def text_of(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    row = " || ".join(text_of(c) for c in FIELDS)
    changed = " || ".join(text_of(lower if c == "text" else c) for c in FIELDS)
    codes = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)"
    shifts = "list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b))"
    crc = f"xor(list_reduce({codes}, lambda c, b: {shifts}, 4294967295), 4294967295)"
    run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
    parts = [
        f"rows AS (SELECT doc_id, source, sha256({row}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({changed}) END AS tampered FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM rows)",
        "s0 AS (SELECT tree, pos, n, leaf AS x FROM d)",
    ]

    def levels(name: str) -> Iterator[str]:
        for k in range(_LEVELS):
            yield f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN max(x) ELSE sha256(string_agg(x, '' ORDER BY pos)) END AS x FROM {name}{k} GROUP BY tree, pos // 16, n)"
            yield f"{name}w{k} AS (SELECT tree, pos, n, coalesce(string_agg(x, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(x, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"

    def folds(name: str, before: str) -> Iterator[str]:
        for k in range(_LEVELS):
            yield f"{name}f{k} AS (SELECT f.* REPLACE (f.pos // 16 AS pos, CASE WHEN w.n = 1 THEN node ELSE sha256(l || node || r) END AS node, CASE WHEN w.n = 1 THEN proof ELSE proof || l || r END AS proof) FROM {before} f JOIN {name}w{k} w USING (tree, pos))"
            before = f"{name}f{k}"

    parts += levels("s")
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, x FROM s{_LEVELS})")
    parts += levels("t")
    parts.append("start AS (SELECT doc_id, leaf, tree, pos, coalesce(tampered, leaf) AS node, '' AS proof FROM d)")
    parts += folds("s", "start")
    parts.append(f"up AS (SELECT f.* REPLACE (0 AS tree, f.tree AS pos), t.x AS subroot FROM sf{_LEVELS - 1} f JOIN s{_LEVELS} t USING (tree))")
    parts += folds("t", "up")
    end = f"SELECT doc_id, leaf, subroot, x AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = x AS verified FROM tf{_LEVELS - 1}, (SELECT x FROM t{_LEVELS})"
    return f"WITH {', '.join(parts)} {end}"


ORACLE = _oracle()
