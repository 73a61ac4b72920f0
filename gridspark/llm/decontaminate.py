"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document is contaminated by an item if some window of the item (``window`` characters, a window every ``step``
characters and one at the item's end; an item below that length is one window) occurs in it within
``error_rate`` * window edits. Case and runs of whitespace do not matter.

The lemma: an occurrence of a window of w characters with at most e edits shares at least w + 1 - q (e + 1)
q-grams with it, all in one band of e + 1 neighbouring diagonals (document position minus item position). So
shared q-grams are counted in bands of ``BAND`` + e diagonals that overlap by e; only windows that reach the bound
in a band are kept, and a banded alignment decides on each. The filter loses nothing.

Windows are looked at in segments of a few; equal windows of an item are looked at once. Where a document shares very
many pairs of places with the items, what is counted is which of a window's places have their q-gram in a band, so a
run of dashes in both texts counts once for each place and band, in chunks of bounded size; and the inside of the
document's long runs of short period is left out, which holds nothing that their ends don't. So memory is bounded
whatever the texts, and the filter still loses nothing.

An item of under q characters has no q-gram; it is found where it stands as a whole word or words, without edits.

The items of a block go to every task in a table of bounded size; a larger benchmark takes several blocks, each
one more map over the documents. There is no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table

#: Diagonals by which bands follow each other; any number gives the same result.
BAND = 16
#: Characters of a document that are looked at together; slices overlap by more than any occurrence takes.
SLICE = 1 << 17
#: Windows of a segment, and bands of places that are counted together (a segment's at least).
SEGMENT = 32
CHUNK = 1 << 21
#: Pairs of places in a slice from which bands are counted instead, and long runs of periods up to LONGEST shortened.
MANY = 1 << 18
LONGEST = 16
#: Characters of benchmark items in one block.
BLOCK_CHARS = 4_000_000
_P = 0x9E3779B97F4A7C15


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q codes, q a power of two, by doubling."""
    h, width, p = c, 1, _P
    while width < q:
        h = h[: max(0, len(h) - width)] * np.uint64(p) + h[width:]
        width, p = 2 * width, p * p % (1 << 64)
    return h ^ (h >> np.uint64(32))


def window_starts(length: int, window: int, step: int) -> list[int]:
    if length <= window:
        return [0]
    return [*range(0, length - window, step), length - window]


def edits_allowed(length: int, error_rate: float, q: int) -> int:
    """The edit budget of a window; never so large that the lemma's bound falls below one shared q-gram."""
    return max(0, min(int(error_rate * length), length // q - 1))


@dataclass(frozen=True)
class Items:
    """One block of benchmark items, ready for the search."""

    ids: list
    texts: list[str]
    q: int
    window: int
    step: int
    error_rate: float

    def prepared(self) -> Items:
        """The q-grams of all segments, by hash: segment, place in the item, first and last window that hold them."""
        window: list[tuple[int, int, int]] = []  # item, start, segment
        grams, segments, places = [], [], []
        lengths = np.array([len(t) for t in self.texts], np.int64)
        widths = np.minimum(lengths, self.window)
        segment = -1
        for item, text in enumerate(self.texts):
            w = int(widths[item])
            if w < self.q:
                continue
            hashes, seen, held, before = gram_hashes(codes(text), self.q), set(), 0, None
            for start in window_starts(len(text), self.window, self.step):
                if text[start : start + w] in seen:
                    continue
                seen.add(text[start : start + w])
                apart = before is None or start - before > w - self.q
                if apart or held == SEGMENT:
                    segment, held, before = segment + 1, 0, None
                held += 1
                window.append((item, start, segment))
                here = np.arange(start if before is None else before + w - self.q + 1, start + w - self.q + 1)
                grams.append(hashes[here])
                places.append(here)
                segments.append(np.full(len(here), segment))
                before = start
        gram, seg, place = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((grams, np.uint64), (segments, np.int64), (places, np.int64)))
        order = np.argsort(gram, kind="stable")
        gram, seg, place = gram[order], seg[order], place[order]
        items, starts, of = (np.array(x, np.int64) for x in (zip(*window) if window else ((), (), ())))
        names, first = np.unique(gram, return_index=True)
        there = np.zeros(1 << 22, bool)
        there[self._slot(names)] = True
        edits = np.array([edits_allowed(w, self.error_rate, self.q) for w in widths.tolist()], np.int64)
        need = np.maximum(1, widths + 1 - self.q * (edits + 1))
        at = of << 33 | starts  # windows rise by segment, then start
        least = seg << 33 | np.maximum(0, place - (widths[items[np.searchsorted(of, seg)]] - self.q) if len(seg) else place)
        found = dict(widths=widths, edits=edits, most=int(edits.max(initial=0)), need=need, codes=codes("".join(self.texts)), offset=np.cumsum(lengths) - lengths)
        found |= dict(window_item=items, window_start=starts, first_window=np.searchsorted(of, np.arange(segment + 2)))
        found |= dict(grams=names, first=np.append(first, len(gram)), segment=seg, place=place, there=there)
        found |= dict(low=np.searchsorted(at, least), high=np.searchsorted(at, seg << 33 | place, "right") - 1)
        found["segment_need"] = need[items[found["first_window"][:-1]]] if len(items) else np.empty(0, np.int64)
        found["short"] = self._automaton()
        for name, value in found.items():
            object.__setattr__(self, "_" + name, value)
        return self

    def _automaton(self) -> ahocorasick.Automaton | None:
        """Finds the items that are too short for a q-gram; an item's word ends are told by the spaces around it."""
        numbers: dict[str, list[int]] = {}
        for number, text in enumerate(self.texts):
            if len(text) < self.q:
                numbers.setdefault(text, []).append(number)
        short = ahocorasick.Automaton()
        for text, same in numbers.items():
            short.add_word(text, (len(text), same))
        if not numbers:
            return None
        short.make_automaton()
        return short

    def _whole_words(self, text: str) -> Iterator[tuple[int, int]]:
        """(number, end) of every short item where no letter, digit or underscore adjoins it."""
        for last, (length, numbers) in self._short.iter(text):
            around = text[max(0, last - length) : last - length + 1] + text[last + 1 : last + 2]
            if not any(c.isalnum() or c == "_" for c in around):
                yield from ((number, last + 1) for number in numbers)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(_P)) >> np.uint64(42)).astype(np.int64)

    def shared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the document's q-grams that items have, and the q-grams' numbers."""
        h = gram_hashes(c, self.q)
        at = np.flatnonzero(self._there[self._slot(h)])
        k = np.minimum(np.searchsorted(self._grams, h[at]), max(0, len(self._grams) - 1))
        real = self._grams[k] == h[at] if len(self._grams) else np.zeros(len(at), bool)
        return at[real], k[real]

    def regions(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of every window that reaches the lemma's bound in a band.

        Few pairs of places are looked at one by one: a pair more than once in a window's count only keeps the window.
        """
        sizes = self._first[k + 1] - self._first[k]
        if int(sizes.sum()) > MANY:
            return self._by_band(at, k)
        rows, of = expanded(self._first[k], sizes)
        segment = self._segment[rows]
        near = np.bincount(segment, minlength=len(self._segment_need))[segment] >= self._segment_need[segment]
        rows, diagonal = rows[near], at[of[near]] - self._place[rows[near]]
        again = diagonal % BAND < self._most  # also in the band before
        return self._reached(np.concatenate([rows, rows[again]]), np.concatenate([diagonal // BAND, diagonal[again] // BAND - 1]))

    def _by_band(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, counting places of items whose q-gram lies in a band, in chunks of segments.

        For a place j = 16 a + r, the band of a document position d is (d - r) // 16 - a, so the bands of a q-gram are made
        distinct once for each residue.
        """
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        own, begin, held = np.unique(k, return_index=True, return_counts=True)
        rows, of = expanded(self._first[own], self._first[own + 1] - self._first[own])
        pairs, pair = np.unique(of * BAND + self._place[rows] % BAND, return_inverse=True)
        places, number = expanded(begin[pairs // BAND], held[pairs // BAND])
        x = at[places] - pairs[number] % BAND
        again = x % BAND < self._most
        keys = np.unique(np.concatenate([number << 40 | x // BAND + 2, number[again] << 40 | x[again] // BAND + 1]))
        bands, sizes = (keys & ((1 << 40) - 1)) - 2, np.bincount(keys >> 40, minlength=len(pairs))
        by_segment = np.argsort(self._segment[rows], kind="stable")
        rows, pair = rows[by_segment], pair[by_segment]
        first, sizes, segment = np.cumsum(sizes)[pair] - sizes[pair], sizes[pair], self._segment[rows]
        total = np.cumsum(sizes)
        news = np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(segment))  # where segments begin
        out, low = [(np.empty(0, np.int64),) * 2], 0
        while low < len(segment):
            fits = int(np.searchsorted(total, total[low] - sizes[low] + CHUNK, "right"))
            high = int(news[max(int(np.searchsorted(news, fits, "right")) - 1, int(np.searchsorted(news, low, "right")))])
            places, number = expanded(first[low:high], sizes[low:high])
            mine = rows[low:high][number]
            out.append(self._reached(mine, bands[places] - self._place[mine] // BAND))
            low = high
        return tuple(np.concatenate(x) for x in zip(*out))

    def _reached(self, rows: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches the bound, by index rows and the bands in which their q-grams lie."""
        base = 1 << 32  # bands can lie before the document
        keys, number, count = np.unique(self._segment[rows] << 40 | bands + base, return_inverse=True, return_counts=True)
        need = self._segment_need[keys >> 40]
        enough = count >= need
        if not enough.any():
            return (np.empty(0, np.int64),) * 2
        rank = np.cumsum(enough) - 1
        used = enough[number]
        number, rows = rank[number[used]], rows[used]
        need, keys = need[enough], keys[enough]
        first = self._first_window[keys >> 40]
        steps = np.zeros((len(keys), SEGMENT + 1), np.int32)
        np.add.at(steps, (number, self._low[rows] - first[number]), 1)
        np.add.at(steps, (number, self._high[rows] + 1 - first[number]), -1)
        k, n = np.nonzero(np.cumsum(steps, 1)[:, :SEGMENT] >= need[:, None])
        return first[k] + n, ((keys[k] & ((1 << 40) - 1)) - base) * BAND

    def found(self, text: str | None) -> list[tuple]:
        """(item_id, edits, item_start, item_end, doc_end) of the best window of every item in the text."""
        text = folded(text)
        overlap = 2 * self.window + 2 * BAND
        best: dict[int, tuple] = {}
        for low in range(0, max(1, len(text)), SLICE):
            c, origin = codes(text[low : low + SLICE + overlap]), None
            at, k = self.shared(c)
            if int((self._first[k + 1] - self._first[k]).sum()) > MANY:
                c, origin = shortened(c, 2 * (self.window + self._most))
                at, k = self.shared(c)
            if len(at):
                window, diagonal = self.regions(at, k)
                order = np.lexsort((diagonal, window))
                self._aligned(c, window[order], diagonal[order], low, origin, best)
        if self._short:
            for number, end in self._whole_words(text):
                best.setdefault(number, (0, 0, end))
        return [
            (self.ids[n], edits, s, s + min(self.window, len(self.texts[n])), end) for n, (edits, s, end) in sorted(best.items())
        ]

    def _aligned(self, c: np.ndarray, window: np.ndarray, diagonal: np.ndarray, low: int, origin: np.ndarray | None, best: dict[int, tuple]) -> None:
        """Aligns windows, which rise by item, start and diagonal; after an exact one no later one of its item is better."""
        widths = self._widths[self._window_item[window]]
        for w in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == w)
            e = edits_allowed(w, self.error_rate, self.q)
            for part in range(0, len(mine), 512):
                k = mine[part : part + 512]
                item, start = self._window_item[window[k]], self._window_start[window[k]]
                exact = {n for n in np.unique(item).tolist() if n in best and best[n][0] == 0}
                if exact:
                    k = k[[n not in exact or best[n][1] > s for n, s in zip(item.tolist(), start.tolist())]]
                    item, start = self._window_item[window[k]], self._window_start[window[k]]
                pattern = self._codes[(self._offset[item] + start)[:, None] + np.arange(w)]
                edits, end = banded(pattern, c, start + diagonal[k] - e, BAND + 3 * e, e)
                for j in np.flatnonzero(edits <= e).tolist():
                    number, last = int(item[j]), int(end[j])
                    if origin is not None and 0 < last <= len(origin):
                        last = int(origin[last - 1]) + 1
                    row = (int(edits[j]), int(start[j]), low + last)
                    best[number] = min(best.get(number, row), row)


def expanded(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin, begin + 1, ... of every range, and which range each is of."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + begin[of], of


def shortened(c: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes without the inside of long runs of a period up to LONGEST, and where the kept ones stood.

    Of a run ``side`` codes or more stay at both ends, and a whole number of periods goes. Any stretch of up to ``side`` codes
    that stood in the text still does, where it stood first, and no other one arises.
    """
    origin = np.arange(len(c))
    for p in range(1, LONGEST + 1):
        if len(c) <= 2 * side + p:
            break
        same = np.append(c[p:] == c[:-p], False)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same])))
        begin, end = edge[::2], edge[1::2] + p  # runs of period p
        long = end - begin > 2 * side + 2 * p
        keep = np.ones(len(c), bool)
        for b, e in zip(begin[long].tolist(), end[long].tolist()):
            cut = (e - b - 2 * side - p) // p * p
            keep[b + side + p : b + side + p + cut] = False
        c, origin = c[keep], origin[keep]
    return c, origin


def banded(pattern: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edits of each pattern row against any stretch of the text, and where that stretch ends.

    Row k may use the cells whose text position minus pattern position is first[k] to first[k] + width; all
    rows go through the dynamic programme together, and those above ``most`` edits leave it early (their result
    is then ``most`` + 1). Outside the text stands a character equal to none, which never makes a row cheaper.
    """
    rows, m = pattern.shape
    offsets = np.arange(width + 1, dtype=np.int32)
    blank = np.uint64(1 << 40)
    at = first[:, None] + np.arange(m + width)
    there = (at >= 0) & (at < len(text))
    near = np.where(there, text[np.clip(at, 0, len(text) - 1)], blank) if len(text) else np.full(at.shape, blank)
    edits, end = np.full(rows, (m if most is None else most) + 1, np.int64), first + m
    live = np.arange(rows)
    cost = np.zeros((rows, width + 1), np.int32)
    for i in range(m):
        now = cost + (near[:, i : i + width + 1] != pattern[:, i : i + 1])
        np.minimum(now[:, :-1], cost[:, 1:] + 1, out=now[:, :-1])
        cost = np.minimum.accumulate(now - offsets, axis=1) + offsets  # further text characters, one edit each
        if most is not None and i % 8 == 7:
            good = cost.min(1) <= most
            if not good.all():
                live, cost, near, pattern = live[good], cost[good], near[good], pattern[good]
                if not len(live):
                    return edits, end
    k = cost.argmin(1)
    edits[live], end[live] = cost[np.arange(len(live)), k], first[live] + k + m
    return edits, end


def item_blocks(benchmark: DataFrame, q: int, window: int, step: int, error_rate: float, block_chars: int, least_chars: int = 1) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_chars``; items of under ``least_chars`` characters are no evidence of anything."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = sorted((folded(r["text"]), r["item_id"]) for r in items.where(block == k).collect() if r["item_id"] is not None)
        rows = [r for r in rows if len(r[0]) >= max(1, least_chars)]
        yield Items([i for _, i in rows], [t for t, _ in rows], q, window, step, error_rate)


def _shared(docs: DataFrame, items: Items):
    sent = docs.sparkSession.sparkContext.broadcast(items)
    state: list[Items] = []

    def get() -> Items:
        if not state:
            state.append(sent.value.prepared())
        return state[0]

    return get


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 8,
    window: int = 80,
    step: int = 8,
    error_rate: float = 0.1,
    block_chars: int = BLOCK_CHARS,
    least_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for every document and item that occurs in it: doc_id, item_id, edits, item_start, item_end, doc_end.

    The row is that of the window with the fewest edits (ties: the smaller item_start); positions are in the
    folded texts. Null and empty documents contain nothing, null and empty items are contained in nothing, documents
    that repeat give their rows again, items that repeat whole don't, and without items the result is empty. Other
    columns are not read.
    """

    def search(get):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = get()
            for batch in batches:
                rows = [
                    (doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in items.found(text.as_py())
                ]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "edits", "item_start", "item_end", "doc_end"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        return run

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    schema = "doc_id long, item_id long, edits int, item_start long, item_end long, doc_end long"
    found = [
        read.mapInArrow(search(_shared(docs, items)), schema) for items in item_blocks(benchmark, q, window, step, error_rate, block_chars, least_chars)
    ]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, least_chars: int = 1, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no benchmark item: a filter, without a shuffle.

    Items of under ``least_chars`` characters (case and white space folded) drop nothing.
    """
    given = dict(q=8, window=80, step=8, error_rate=0.1) | options
    place = docs.columns.index(text_col)

    def without(get):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = get()
            for batch in batches:
                yield batch.filter(pa.array([not items.found(t.as_py()) for t in batch.column(place)], pa.bool_()))

        return run

    for items in item_blocks(benchmark, block_chars=block_chars, least_chars=least_chars, **given):
        docs = docs.mapInArrow(without(_shared(docs, items)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Characters that an item needs for the pipeline to drop documents that hold it: a q-gram. A shorter one is a common word.
STAGE_LEAST_CHARS = 8


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no passage of the benchmark, of STAGE_LEAST_CHARS characters or more.

    Null and empty texts stay, repeated rows share their fate, columns of any name come back as they are; an empty
    table gives none, and without a benchmark all rows stay.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"), least_chars=STAGE_LEAST_CHARS)
