"""Language identification by compression.

Every language has a raw-content zstandard dictionary: whole texts of that language up to ``dictionary_bytes``, the
last of them cut there.
A text is compressed with each dictionary, and the language whose dictionary gives the smallest result is chosen;
a narrow margin to the second is a rejection. Every language is learnt; the dictionaries come from a bounded sample,
and share ``all_bytes`` where there are many of them. Identification is a map over the documents: no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import held_out, table, written

UNDETERMINED = "und"


@dataclass(frozen=True)
class Languages:
    """The dictionaries, the language with the most rows first: it wins ties."""

    names: list[str]
    dictionaries: list[bytes]
    level: int
    margin: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for d in self.dictionaries:
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
        return made


def prepared(text: str) -> bytes:
    """What is compressed, and what the dictionaries hold: lower case, between two spaces, so that words meet words."""
    return f" {text.lower()} ".encode("utf-8", "replace")


def cut(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes, less a character that they would break."""
    return data[:most].decode("utf-8", "ignore").encode("utf-8")


def judge(text: str | None, languages: Languages, compressors: list) -> tuple[str, float, float, bool]:
    """(language, score, margin, accepted).

    The margin is the share of the second smallest size that the smallest saves; the score is the logistic
    weight, against all other languages, of the bytes saved in the square root of the size.
    """
    if not compressors or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, False
    data = prepared(text)
    sizes = np.array([len(c.compress(data)) for c in compressors], float)
    order = np.argsort(sizes, kind="stable")
    least = sizes[order[0]]
    weight = np.exp(-np.minimum(60.0, (sizes - least) / np.sqrt(least)))
    margin = float(1 - least / sizes[order[1]]) if len(order) > 1 else 1.0
    return languages.names[order[0]], float(1 / weight.sum()), margin, margin >= languages.margin


def fit(
    docs: DataFrame,
    usable: Column | None = None,
    dictionary_bytes: int = 120_000,
    sample_rows: int = 200,
    level: int = 7,
    margin: float = 0.02,
    all_bytes: int = 64_000_000,
) -> Languages:
    """Learns from text and lang of the ``usable`` rows; rows without a lang or without letters teach nothing.

    The bounded sample takes about twice ``sample_rows`` documents of a language, or all if it has fewer, by the hash
    of doc_id. In the order of that hash, texts of more than a quarter of the dictionary last, they fill the dictionary;
    the text that overfills it is cut at a character. ``dictionary_bytes`` falls where the dictionaries of all
    languages would take more than ``all_bytes``, but not below 1,000.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    known = docs.where(F.col("lang").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    known = known.where(usable) if usable is not None else known
    known = known.select("lang", "text", order.alias("_h"))
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "language-counts")
    dictionary_bytes = min(dictionary_bytes, max(1_000, all_bytes // max(1, counts.count())))
    share = F.lit(2.0 * sample_rows) / F.col("_n")
    drawn = F.shiftrightunsigned("_h", 1).cast("double") / float(1 << 63) < share
    # a character takes a byte at least, so no more than this of a text can be used
    drawn = known.join(counts, "lang").where(drawn).select("lang", "_n", F.substring("text", 1, dictionary_bytes).alias("text"), "_h")
    size = F.octet_length("text") + 1
    mine = Window.partitionBy("lang").orderBy(size > dictionary_bytes // 4, "_h", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(mine), F.lit(0))
    used = drawn.select("lang", "_n", "text", before.alias("_before")).where(F.col("_before") < dictionary_bytes)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_before", "text"))), lambda x: x["text"]), "\n")
    rows = used.groupBy("lang", "_n").agg(whole.alias("text")).orderBy(F.col("_n").desc(), "lang").collect()  # all_bytes or so
    return Languages([r["lang"] for r in rows], [cut(prepared(r["text"]), dictionary_bytes) for r in rows], level, margin)


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted of every row, from its whole text.

    Null and empty texts and those without a letter are 'und' with score 0, as is every text if nothing was learnt.
    Languages of equal size go by their number of rows, then by name. Repeated rows are rows of their own, other
    columns are not read, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        compressors = known.compressors()
        for batch in batches:
            rows = [judge(t.as_py(), known, compressors) for t in batch.column(1)]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "margin", "accepted"])

    schema = "doc_id long, lang_pred string, score double, margin double, accepted boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, fit(docs, usable=~out))
    return found.withColumn("held_out", out)
