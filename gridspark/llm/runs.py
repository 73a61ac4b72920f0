"""Periodic runs of words, caught online as words are appended, and texts without the repetitions.

A run of period q is a maximal stretch in which words q apart are identical, q being its smallest period. A *streak* is
the stretch of words that equal the word q before; a run of length n has a streak of n - q words.

Every aligned block of 2, 4, 8, ... words has a catcher once it is complete. A catcher of B words waits for its block to
come again between 2B - 1 and 4B - 2 words later (the smallest ones: 1 to 6) and is done then, so at each level two or
three catchers look at an appended word, whatever the text. A streak of a period in that range that makes a square
(two periods) is so long that it holds a whole block, so no square is missed. Where a block has come again, suffixes
are compared: the streak is followed back from the block, and on as words are appended. Once it is as long as its
period it is a square, further words give further squares, and these are one run until a word differs.

Equal blocks are found by 64-bit polynomial prefix hashes of word numbers; the words of every run are then compared
themselves, so a collision costs time but changes nothing. All words that are appended together are looked at together,
so a batch of texts, each ended by a word of its own, is one call; work is n log n for n words of any kind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table
from gridspark.llm.shingles import mixed

#: Words that are searched together, but a text is never split.
GROUP_WORDS = 200_000
LEAST_WORDS = 12
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EMPTY = np.empty(0, np.int64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class RunCatcher:
    """Finds the runs of one growing sequence of words (numbers), of at least ``least`` words (6 or more) and two periods.

    ``longest``: the longest period to look for; any if not given.
    """

    def __init__(self, least: int = LEAST_WORDS, longest: int | None = None) -> None:
        self.least, self.longest = least, longest
        self.size = 0
        self._words, self._sums = _EMPTY, np.zeros(1, np.uint64)
        self._up = self._down = np.empty(0, np.uint64)
        self._open: dict[int, int] = {}  # period: first word of the streak that reaches the end
        self._closed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (start, end, period) of ended squares

    def _grow(self, words: np.ndarray) -> None:
        """Room doubles when it is full; prefix sums of word hashes times powers of the base go on."""
        first, self.size = self.size, self.size + len(words)
        if self.size > len(self._words):
            room = max(self.size, 2 * len(self._words)) if first else self.size
            self._words = np.concatenate([self._words[:first], np.empty(room - first, np.int64)])
            self._sums = np.concatenate([self._sums[: first + 1], np.empty(room - first, np.uint64)])
            self._up, self._down = powers(_BASE, room + 1), powers(_INVERSE, room + 1)
        self._words[first : self.size] = words
        hashes = mixed(words.astype(np.uint64) + np.uint64(1)) * self._up[first : self.size]
        self._sums[first + 1 : self.size + 1] = self._sums[first] + np.cumsum(hashes)

    def _window(self, at: np.ndarray, length) -> np.ndarray:
        """The hash of the ``length`` words from each position, whatever stands before."""
        return (self._sums[at + length] - self._sums[at]) * self._down[at]

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Takes further words; the runs (start, end, period) in which these made or continued a square."""
        first = self.size
        self._grow(np.asarray(words, np.int64))
        grown, ended = self._advanced(first)
        block = 2
        while True:
            least = 1 if block == 2 else 2 * block - 1
            reach = 3 if block == 2 else 2  # blocks that wait at any one time
            if least + block > self.size or (self.longest is not None and least > self.longest):
                break
            grown += self._caught(block, least, reach, first, ended)
            block *= 2
        return self._settled(grown)

    def _advanced(self, first: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
        """Follows the open streaks through the new words; those that differ are closed. Also (start, end) of each period's."""
        grown, ended = [], {}
        for period, start in list(self._open.items()):
            differ = self._words[first : self.size] != self._words[first - period : self.size - period]
            end = first + int(differ.argmax()) if differ.any() else self.size
            ended[period] = start, end
            if end < self.size:
                del self._open[period]
            row = tuple(np.array([x]) for x in (start - period, end, period))
            if end - start >= max(self.least - period, period):
                if end > first:
                    grown.append(row)
                if end < self.size:
                    self._closed.append(row)
        return grown, ended

    def _caught(self, block: int, least: int, reach: int, first: int, known: dict[int, tuple[int, int]]) -> list[tuple]:
        """What the catchers of one level find in the words from ``first``."""
        low = max(0, (max(0, first - block + 1) - least) // block)  # a block's number; earlier windows were looked at
        ends = self.size - block + 1
        begin = least + block * low
        if ends <= begin:
            return []
        rows = -(-(ends - begin) // block)
        seen = self._window(np.arange(begin, ends), block)
        seen = np.append(seen, np.zeros(rows * block - len(seen), np.uint64)).reshape(rows, block)
        waiting = self._window(np.arange(max(0, low - reach + 1), low + rows) * block, block)
        skipped = low - max(0, low - reach + 1)
        found = []
        for back in range(reach):
            shift = skipped - back  # the block of row r is waiting[r + shift]
            top = max(0, -shift)
            row, column = np.nonzero(seen[top:] == waiting[top + shift : rows + shift, None])
            found.append((begin + (row + top) * block + column, (low + row + top - back) * block))
        at, of = (np.concatenate(x) for x in zip(*found))
        period = at - of
        keep = (at < ends) & (at > first - block)
        if self.longest is not None:
            keep &= period <= self.longest
        for p, (_, end) in known.items():  # the streak itself
            keep &= (period != p) | (at >= end)
        for p, (start, end) in [*known.items(), *((p, (s, self.size)) for p, s in self._open.items())]:
            if end - start >= p:  # inside a run, a multiple of its period says nothing
                keep &= (period % p != 0) | (of < start - p) | (at + block > end)
        at, of, period = at[keep], of[keep], period[keep]
        if not len(at):
            return []
        # neighbouring blocks that come again at one distance are one streak
        order = np.lexsort((of, period))
        at, of, period = at[order], of[order], period[order]
        new = np.append(True, (np.diff(period) != 0) | (np.diff(of) != block))
        head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
        period, start, end = period[head], at[head], at[tail] + block
        start = start - self._common(of[head], start, np.minimum(of[head], block), -1)
        end = end + self._common(end - period, end, np.minimum(self.size - end, block), 1)
        for p, s in zip(period[end == self.size].tolist(), start[end == self.size].tolist()):
            self._open[p] = s
        square = end - start >= np.maximum(self.least - period, period)
        runs = (start - period)[square], end[square], period[square]
        done = runs[1] < self.size
        if done.any():
            self._closed.append(tuple(x[done] for x in runs))
        return [runs]

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words, up to ``most``, agree after (before) the positions a and b: by halving, never too few."""
        low, high = np.zeros(len(a), np.int64), most + 1  # low agree, high don't
        while (wide := high - low > 1).any():
            k = np.where(wide, (low + high) // 2, low)
            back = k if way < 0 else 0
            same = self._window(a - back, k) == self._window(b - back, k)
            low, high = np.where(same, k, low), np.where(same | ~wide, high, k)
        return low

    def _settled(self, rows: list[tuple]) -> list[tuple[int, int, int]]:
        """Of stretches with several periods the smallest counts; words are compared before a run is told."""
        if not rows:
            return []
        start, end, period = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[: len(start)]
        out = set()
        for s, e, q in zip(start[first].tolist(), end[first].tolist(), period[first].tolist()):
            out.update(self._verified(s, e, q))
        return sorted(out, key=lambda r: (r[0], r[2], r[1]))

    def _verified(self, start: int, end: int, period: int) -> list[tuple[int, int, int]]:
        """The run itself; if hashes have collided, what is a run in its place."""
        w = self._words
        differ = np.flatnonzero(w[start + period : end] != w[start : end - period])
        if not len(differ):
            return [(start, end, period)]
        out, cuts = [], [start - 1, *(differ + start).tolist(), end - period]
        for low, high in zip(cuts, cuts[1:]):  # streaks without their first period
            s, e = low + 1, high
            if e <= s:
                continue
            while s > 0 and w[s - 1] == w[s - 1 + period]:
                s -= 1
            while e + period < self.size and w[e] == w[e + period]:
                e += 1
            if e - s >= max(self.least - period, period):
                stretch = w[s : e + period]
                q = next(q for q in range(1, period + 1) if np.array_equal(stretch[q:], stretch[:-q]))
                out.append((s, e + period, q))
        return out

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of all runs in the words so far, by start, then period."""
        still = [(s - p, self.size, p) for p, s in self._open.items() if self.size - s >= max(self.least - p, p)]
        rows = [*self._closed, *[tuple(np.array(x) for x in zip(*still))] * bool(still)]
        return self._settled(rows)


# -- texts ------------------------------------------------------------------------------------------------------


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document repeats a stretch of its words to its end; which and how long tells the id's crc32."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * -(-(n - a) // period))[: n - a]


def runs_of(texts: list[list[int]], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, period) of each list of word numbers (from 0), all in one search."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    longest = int(sizes.max(initial=0)) // 2
    catcher = RunCatcher(least, longest)
    if longest:
        words: list[int] = []
        for k, text in enumerate(texts):
            words += text
            words.append(-1 - k)  # a word of its own ends each text
        catcher.append(np.array(words))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = catcher.runs()
    for (s, e, q), k in zip(found, np.searchsorted(starts, [s for s, _, _ in found], "right") - 1):
        low = int(starts[k])
        out[k].append((s - low, e - low, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, e, q in runs:
        depth[s + q] += 1
        depth[e] -= 1
    return np.flatnonzero(np.cumsum(depth[:n]) == 0)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def collapse(
    docs: DataFrame,
    least: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    plant: bool = False,
    with_text: bool = False,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """One row for each document: doc_id, n_runs, the run of the greatest length (start, length, period,
    exponent_milli; ties: the smallest start, then period), runs_sha256, collapsed_sha256 and, with ``with_text``,
    runs (array of start, length, period) and collapsed (the kept words, joined by one space).

    Words are separated by ASCII white space. Null and empty texts have no word and no run; rows that repeat are
    treated alike, each on its own; a null id is no different from others. Texts of any length are taken whole. Other
    columns are not read, so no name clashes. An empty table gives an empty result. ``plant`` makes every tenth
    document periodic first (``planted``). One map, no shuffle.
    """
    names = NAMES + ["runs", "collapsed"] * with_text
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * with_text
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type, pa.string()] * with_text

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in texts]
        made = []
        for doc, words, runs in zip(ids, texts, runs_of(coded, least)):
            told = [(s, e - s, q) for s, e, q in runs]
            best = max(told, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in told)
            if runs:
                words = [words[k] for k in kept_words(len(words), runs).tolist()]
            text = b" ".join(words)
            row = [doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
            row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
            if with_text:
                row += [[dict(zip(("start", "length", "period"), r)) for r in told], text.decode("utf-8", "surrogatepass")]
            made.append(row)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                ids.append(doc)
                texts.append(planted(doc, words) if plant else words)
                held += len(words) + 1
                if held >= group_words:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "documents"), plant=True)
