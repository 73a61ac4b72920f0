"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Fitting uses a bounded sample of the labelled rows: up to ``examples`` rows of each class go into the index
and up to ``calibration`` more rows of each class calibrate the votes, weighing as much as their class has rows
among all labels that may be learnt from. Terms are words and their
four-letter beginnings, all those of the examples; a term weighs by how well the examples' classes differ in it
(``evidence``), and one that tells nothing still weighs a little, so a copy of an example has cosine 1 with it.
Document frequencies are counted over all documents.

The index is bounded by the examples, so broadcasting it is safe at any corpus size. Scoring is a map over the
documents: no shuffle and no join. Like examples stand in the same block. The postings of rare terms are added up in
full; the weights of common terms are kept as matrices by block, with each term's largest, and are only read for the
blocks which can still hold one of the nearest, so the neighbours are exactly those of full scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import free_name, held_out, table, written

WORD = re.compile(r"\w+")
BLOCK = 64
#: Terms in more than this share of the examples are common; a row of them takes 80 bytes a posting at most.
COMMON = 0.1
#: Texts that are scored together.
TOGETHER = 64
#: Words that a task remembers the numbers of.
REMEMBERED = 200_000


def features(text: str | None) -> list[str]:
    """Lower-case words and, for words of over four letters, their beginnings, marked by '^'."""
    words = WORD.findall((text or "").lower())
    return words + ["^" + w[:4] for w in words if len(w) > 4]


class Numbers(dict):
    """The numbers of a word and of its beginning, plus one each, in one integer; filled as words are met."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        start = self.number.get("^" + word[:4], -1) if len(word) > 4 else -1
        both = (self.number.get(word, -1) + 1) << 32 | (start + 1)
        if len(self) < REMEMBERED:
            self[word] = both
        return both

    def __reduce__(self):
        return Numbers, (self.number,)


def counted(text: str | None, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known features in the text, rising, and how often each occurs."""
    words = Counter(WORD.findall((text or "").lower()))
    both = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    often = np.fromiter(words.values(), np.float64, len(words))
    found, often = np.concatenate([both >> 32, both & 0xFFFFFFFF]), np.concatenate([often, often])
    terms, where = np.unique(found[found > 0] - 1, return_inverse=True)
    return terms, np.bincount(where, often[found > 0], len(terms))


def evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int, doubt: float = 4.0) -> np.ndarray:
    """Weight of terms that a of n1 examples of one class and b of n0 of the other hold.

    It is the squared difference of the two shares over their sum, less for terms of few examples. No term weighs 0: one
    that tells nothing weighs as much as the evidence of a single example, so there is no further number to choose.
    """
    least = 1 / (1 + doubt) ** 2
    r1, r0 = a / max(1, n1), b / max(1, n0)
    apart = np.abs(r1 - r0) / np.maximum(r1 + r0, 1e-300) if n1 and n0 else np.zeros(len(a))
    return least + (apart * (a + b) / (a + b + doubt)) ** 2


def weighed(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights: (1 + ln tf) * idf."""
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def alike_order(rows: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which like ones stand together: halves along the widest direction, down to blocks."""
    order: list[int] = []
    parts = [np.arange(len(rows))]
    while parts:
        part = parts.pop()
        if len(part) <= block or not rows.shape[1]:
            order += part.tolist()
            continue
        about = rows[part]
        about -= about.mean(0)
        along = np.random.default_rng(1).normal(size=rows.shape[1])
        for _ in range(8):
            along = about.T @ (about @ along)
            along /= np.sqrt(along @ along) + 1e-300
        part = part[np.argsort(about @ along, kind="stable")]
        half = block * -(-len(part) // (2 * block))
        parts += [part[half:], part[:half]]
    return np.array(order, np.int64)


Vector = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Weights of each term by example: postings of rare terms; of common ones a matrix for each block, and their largest."""

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.blocks = -(-self.size // block)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        example = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) > COMMON * self.size)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        here = self.row[term] >= 0
        rows = np.zeros((self.size, len(common)))
        rows[example[here], self.row[term[here]]] = weight[here]
        self.order = alike_order(rows, block)  # the example at each place
        del rows  # the driver holds the common weights once at a time
        place = np.empty(self.size, np.int32)
        place[self.order] = np.arange(self.size)
        at = place[example]
        self.rows = np.zeros((self.blocks, len(common), block))
        self.rows[at[here] // block, self.row[term[here]], at[here] % block] = weight[here]
        self.most = self.rows.max(2)
        term, at, weight = term[~here], at[~here], weight[~here]
        order = np.lexsort((at, term))
        self.at, self.weight = at[order], weight[order]
        # the postings of the rare term t are those from start[t] to start[t + 1]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nearest(self, queries: list[Vector], k: int) -> list[Vector]:
        """For each query the k examples of the largest cosine above 0 (ties: the smaller example number), and the cosines."""
        if not self.size:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        score = np.empty((len(queries), self.blocks * self.block))
        common = np.zeros((len(queries), self.rows.shape[1]))
        for q, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            here = row >= 0
            common[q, row[here]] = weights[here]
            first = self.start[terms[~here]]
            n = self.start[terms[~here] + 1] - first
            posting = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            score[q] = np.bincount(self.at[posting], np.repeat(weights[~here], n) * self.weight[posting], score.shape[1])
        by_block = score.reshape(len(queries), self.blocks, self.block)
        bound = by_block.max(2) + common @ self.most.T
        # the block of the largest bound first; then those that may still beat the k-th best of what is known
        opened = bound >= bound.max(1, keepdims=True)
        self._add(by_block, common, opened)
        self._add(by_block, common, ~opened & (bound >= self._least(score, k)[:, None] - 1e-9))
        least, found = self._least(score, k), []
        for one, low in zip(score, least):
            at = np.flatnonzero((one > 0) & (one >= low - 1e-9))
            example, cosine = self.order[at], one[at]
            best = np.lexsort((example, -np.round(cosine, 12)))[:k]
            found.append((example[best], cosine[best]))
        return found

    def _add(self, score: np.ndarray, common: np.ndarray, opened: np.ndarray) -> None:
        """Adds the common terms' products in the opened (query, block) cells."""
        for block in np.flatnonzero(opened.any(0)):
            some = np.flatnonzero(opened[:, block])
            score[some, block] += common[some] @ self.rows[block]

    @staticmethod
    def _least(score: np.ndarray, k: int) -> np.ndarray:
        """Each row's k-th largest value; 0 if it has fewer."""
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(score))


@dataclass(frozen=True)
class ToxicityModel:
    """A fitted model; its size is that of the examples, whatever the corpus."""

    numbers: Numbers
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    neighbours: int
    slope: float
    offset: float

    def votes(self, texts: Iterable[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the share of label 1 among the neighbours, each weighing cosine^2 / (0.05 + distance), and the evidence.

        One unit of weight for label 0 stands for what is unlike every example; so the vote of a text
        without any known term is 0.
        """
        for part in batched(texts, TOGETHER):
            known = (counted(text, self.numbers) for text in part)
            for near, cosine in self.index.nearest([(t, weighed(t, c, self.idf)) for t, c in known], self.neighbours):
                w = cosine**2 / (0.05 + np.maximum(0.0, 1 - cosine))
                yield float((w * self.labels[near]).sum() / (1 + w.sum())), self.ids[near], cosine

    def probability(self, vote):
        return 1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -50, 50)))


#: Calibration needs so many rows of each class; with fewer, a vote of 0.5 decides.
LEAST_SIDE = 5
FALLBACK = (10.0, -5.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a lightly regularised weighted logistic fit, by Newton steps that never lose."""
    a = np.stack([x, np.ones_like(x)], 1)
    ridge = np.array([1e-2, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-12, 1 - 1e-12))
    b = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (y - p)) - ridge * b)
        step *= min(1.0, 10 / np.abs(step).max()) if step.any() else 1.0
        now = loss(b)
        while np.abs(step).max() > 1e-9 and loss(b + step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        b = b + step
    return max(0.0, float(b[0])), float(b[1])


def _chosen(labels: DataFrame, examples: int, calibration: int) -> tuple[DataFrame, list[int]]:
    """doc_id, label, part of a bounded sample, and the number of all rows of each label.

    Rows are taken by rising hash of doc_id, so any partitioning gives the same. A fifth of the rows, told by
    another hash, can only go into calibration; the index takes from the others. A class without others gives
    its fifth to the index and none to calibration.
    """
    order = [F.xxhash64("doc_id", F.lit(10)), F.col("doc_id")]
    labels = labels.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0)
    counts = {(r["label"], r["apart"]): r["count"] for r in labels.groupBy("label", "apart").count().collect()}  # at most four rows
    sides = []
    for y in (0, 1):
        side = labels.where(F.col("label") == y)
        if (y, False) in counts:
            sides.append(side.where(~F.col("apart")).orderBy(*order).limit(examples).withColumn("part", F.lit("index")))
            sides.append(side.where("apart").orderBy(*order).limit(calibration).withColumn("part", F.lit("calibration")))
        else:
            sides.append(side.orderBy(*order).limit(examples).withColumn("part", F.lit("index")))
    total = [counts.get((y, False), 0) + counts.get((y, True), 0) for y in (0, 1)]
    return reduce(DataFrame.unionByName, sides).drop("apart"), total


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    examples: int = 2048,
    calibration: int = 2048,
    neighbours: int = 15,
) -> ToxicityModel:
    """Fits on labels (doc_id, toxic), of which ``usable`` (a condition on doc_id) says which rows may be learnt from.

    Rows whose toxic or doc_id is null teach nothing, as do labels without a document; of repeated labels
    of a document the largest counts, and of documents that repeat an id the text that is first in byte order. Without rows labelled toxic every score is 0. Where a class has fewer than
    ``LEAST_SIDE`` rows for calibration, the score is a fixed rising function of the vote, 0.5 at a vote of 0.5.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    drawn, total = _chosen(known, examples, calibration)
    chosen = written(drawn, "chosen")
    sample = written(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "part", "label").agg(F.min("text").alias("text")), "sample")

    # the terms of the index part of the sample, and how often each class has them
    @F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
    def terms_of(text):
        return sorted(set(features(text)))

    part = sample.where("part = 'index'")
    n0, n1 = (part.where(F.col("label") == y).count() for y in (0, 1))
    seen = part.select("label", F.explode(terms_of("text")).alias("term")).groupBy("term")
    told = seen.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).orderBy("term").toArrow()  # the examples' terms
    known_terms = Numbers({t: k for k, t in enumerate(told["term"].to_pylist())})
    telling = evidence(*(told[c].to_numpy().astype(float) for c in ("a", "b")), n1, n0)
    terms = len(telling)
    del told
    numbers = spark.sparkContext.broadcast(known_terms)  # its own value would be a second copy in the driver

    # document frequencies of these terms over all documents: at most one sum of each from a task
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(terms, np.int64)
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0):
                df[counted(text.as_py(), numbers.value)[0]] += 1
        rows = np.append(np.flatnonzero(df), terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array(np.append(df, total)[rows])], names=["term", "n"]
        )

    sums = docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(terms + 1)
    got = sums.toArrow()  # one row for each term
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * telling

    def vectors(rows: DataFrame) -> list:
        @F.udf(returnType="terms array<int>, counts array<int>", useArrow=True)
        def vector(text):
            t, c = counted(text, numbers.value)
            return t.tolist(), c.astype(np.int32).tolist()

        got = rows.select("doc_id", "label", vector("text").alias("v")).select("doc_id", "label", "v.*").orderBy("doc_id").toArrow()
        arrays = [[x.values.to_numpy() for x in got[c]] for c in ("terms", "counts")]
        return list(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), *arrays))

    held = vectors(part)  # at most 2 * examples rows
    numbers.destroy()  # the model holds them from here on
    ids, marks = np.array([d for d, *_ in held], np.int64), np.array([y for _, y, _, _ in held], float)
    weights = [(t, weighed(t, c, idf)) for _, _, t, c in held]
    del held
    model = ToxicityModel(known_terms, idf, BlockMaxIndex(weights, terms), marks, ids, neighbours, 0.0, -50.0)
    del weights
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([v for v, _, _ in shared.value.votes(t.as_py() for t in texts)], pa.float64())

    votes = sample.where("part = 'calibration'").select(vote("text").alias("v"), "label").collect()
    shared.destroy()  # score() sends the model with its slope and offset
    if not total[1]:
        return model
    x, y = np.array([r["v"] for r in votes]), np.array([r["label"] for r in votes], int)
    side = np.bincount(y, minlength=2)
    if side.min() < LEAST_SIDE:
        slope, offset = FALLBACK
    else:
        slope, offset = logistic(x, y.astype(float), (np.array(total) / side)[y])
    return replace(model, slope=slope, offset=offset)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5, into: str = "_toxicity") -> DataFrame:
    """``docs`` with the struct column ``into`` (score, predicted, evidence: doc_id and cosine of neighbours).

    Every row and whole text is scored; null and empty texts too. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double>>"

    @F.arrow_udf(kind)
    def judged(texts: pa.Array) -> pa.Array:
        found = list(shared.value.votes(t.as_py() for t in texts))
        p = shared.value.probability(np.array([v for v, _, _ in found]))
        near, cosine = (np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, t in ((1, np.int64), (2, float)))
        told = pa.StructArray.from_arrays([pa.array(near), pa.array(cosine)], ["doc_id", "cosine"])
        ends = np.cumsum([0, *(len(f[1]) for f in found)]).astype(np.int32)
        columns = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), told)]
        return pa.StructArray.from_arrays(columns, ["score", "predicted", "evidence"])

    return docs.withColumn(into, judged(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document; learns from the rows not held out only."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, labels, usable=~out)
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "_toxicity.score", "_toxicity.predicted", "_toxicity.evidence"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model, fitted on the stage's own input, does not find toxic.

    Null and empty texts, which are like no example, stay; so do all rows if no label marks anything toxic. Repeated
    rows share their fate. Columns of any name come back as they are; an empty table gives none.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), usable=~held_out(F.col("doc_id"), 5, 0))
    told = free_name(docs, "toxicity")
    return score(docs, model, into=told).where(F.col(f"{told}.predicted") == 0).drop(told)
