"""Exact deduplication with the frequent texts split off.

1. Each text is normalised and hashed once; (id, digest, row) goes to a table, so no later step reads text. ``row``
   is a number of the row's own, which tells rows apart that repeat an id.
2. A Misra-Gries summary (Spark's mergeable ``approx_top_k``) over the digests, partial in each task and merged in
   two levels, names the candidates for frequent digests. An exact count over the candidates alone verifies them and
   finds the row that stays. A winner holds 1 of ``SHARE`` rows, so there are at most ``SHARE`` of them.
3. The winners are broadcast. Rows with a winner's digest are settled where they lie, without a shuffle.
4. All other rows are shuffled by digest. No group there holds 1 of ``SHARE`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import broadcast_if_small, free_name, table, written

#: Bytes of whitespace that are folded into one space.
WHITESPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text's UTF-8 after whitespace folding; null counts as the empty text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ").cast("binary"), 256))


#: A digest that holds one of so many rows is split off.
SHARE = 1024
#: Digests that the summary tracks. It may be wrong by under 1 / (2 * SHARE) of the rows, so at most 2 * SHARE digests
#: can be estimated above 1 / SHARE, and as many candidates miss none that is.
TRACKED = 4 * SHARE


def _first() -> Column:
    """What orders the rows of a group: ids rise, nulls come last, and rows that repeat an id go by their number."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "row")


def frequent(digests: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Verified heavy hitters of (id, digest, row): digest, first (none, id, row), group_size; at most ``share`` rows.

    A digest is a winner if it holds at least two rows and 1 of ``share`` of all rows.
    """
    parts = digests.groupBy((F.spark_partition_id() % 64).alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("seen")
    )
    whole = parts.groupBy(F.lit(0).alias("one")).agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(seen, {tracked})").alias("seen"))
    top = whole.select("rows", F.explode(F.expr(f"approx_top_k_estimate(seen, {2 * share})")).alias("top"))
    least = F.greatest(F.lit(2), F.ceil(F.col("rows") / share))
    names = top.where(F.col("top.count") >= least).select(F.col("top.item").alias("name"), least.alias("least"))
    hits = digests.join(F.broadcast(names), F.xxhash64("digest") == F.col("name"))
    return (
        hits.groupBy("digest")
        .agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("group_size"), F.max("least").alias("least"))
        .where(F.col("group_size") >= F.col("least"))
        .drop("least")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after folding each run of whitespace into one space; null and empty
    texts form one group. The row with the smallest id stays; a null id sorts after all others. Of rows
    that repeat an id and a text, one stays. Other columns are not read, so their names cannot clash.
    An empty table gives an empty result.
    """
    digests = written(
        docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    winners = written(frequent(digests, share), "winners")
    won = digests.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    others = won.where("group_size IS NULL").select("id", "row", F.min(_first()).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size"), "digest")
    told = won.where("group_size IS NOT NULL").select(others.columns).unionByName(others)
    return told.select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the smallest doc_id stays; a row repeated whole stays once.

    Null and empty texts are one group. Columns of any name come back as they are; an empty table gives none.
    """
    found = written(exact_dedup(docs).where(~F.col("kept")), "repeats")
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))  # repeats the very row that stays
    # the id finds the row; the hash of the digest tells rows apart that share an id
    digest, lost_id, told = (free_name(docs, x) for x in ("digest_hash", "lost_id", "told"))
    pair = [F.col("doc_id").alias(lost_id), F.xxhash64("text_sha256").alias(told)]
    lost, twice = found.where(~again).select(pair), found.where(again).select(pair).distinct()
    hashed = docs.withColumn(digest, F.xxhash64(F.lower(F.hex(text_digest(F.col("text"))))))
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(digest) == F.col(told))
    kept = hashed.join(broadcast_if_small(lost), same, "left_anti")
    if not twice.isEmpty():
        twice = broadcast_if_small(twice)
        once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", digest])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.select(docs.columns)


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM hashed h JOIN grouped g USING (text_sha256)
"""
