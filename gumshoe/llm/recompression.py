"""Find periodic runs of words with a recompression grammar, and collapse each to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``LEAST`` words and 2 q,
that no neighbouring word extends. A run of period p holds a pair of places (i, i + p) where i is a multiple of p, so only
such pairs of this harmonic grid are candidates, n log n of them in n words; how far the words at the two places agree, to
the right and to the left, gives the run's exact ends.

These extensions are longest common extensions (LCE), answered by a run-length grammar: a level first replaces each block of a
repeated symbol by a symbol for (symbol, length), the next level each pair of a left and a right symbol (by a hash of the
symbol) by a symbol for the pair, and so on. Equal texts get equal symbols away from their ends, so an LCE climbs the levels
while both places are starts of symbols of the next level, and descends again where symbols differ. A level's cut between two
symbols depends on these two alone, so the same grammar serves both directions. All questions climb and descend together.

The grammar is one of some documents at once, with a symbol of its own between any two, which no extension passes.

Nulls and ties: a null or empty text has no words and no run; every row is a document of its own, also with a null or repeated
id; equal runs are found once. A text may be of any length; documents are taken together up to ``PORTION`` words, a longer one is
alone. An empty table gives an empty result. Other columns of the input are passed on as they are,
but for those that have the names of the two new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 12
PORTION = 1 << 18
CANDIDATES = 1 << 21
"""Pairs of the grid that are looked at together: bounds memory only."""
RUNS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D."""
    return (text or b"").split()


def _numbered(keys: np.ndarray, first: int) -> np.ndarray:
    """The same new symbol for equal keys, counted from ``first``."""
    return np.unique(keys, return_inverse=True)[1] + first


def _is_right(symbols: np.ndarray, level: int) -> np.ndarray:
    """One bit of a hash of the symbol and the level: whether the symbol may end a pair."""
    mixed = (symbols.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(40) & np.uint64(1)).astype(bool)


class Level:
    """The symbols of one level and which of them start a symbol of the next."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> None:
        self.symbols, self.starts, self.blocks = symbols, starts, blocks
        n = len(symbols)
        self.begin = np.flatnonzero(starts).astype(np.int32)  # of the symbols of the next level, in this one
        self.above = (np.cumsum(starts) - 1).astype(np.int32)  # the next level's symbol that each one lies in
        self.cut = np.append(starts, True)  # the place behind the last symbol is a cut too
        self.end = np.append(self.begin[1:], n).astype(np.int32)


class Grammar:
    """Alternating block and pair compression of ``symbols``; the last one must be unlike all others."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[Level] = []
        next_symbol = int(symbols.max()) + 1
        stale = 0
        while stale < 4 and len(symbols) > 1:
            n, blocks = len(symbols), len(self.levels) % 2 == 0
            starts = np.ones(n, dtype=bool)
            if blocks:
                np.not_equal(symbols[1:], symbols[:-1], out=starts[1:])
                begin = np.flatnonzero(starts)
                size = np.diff(np.append(begin, n))
                above, many = symbols[begin].copy(), size > 1
                above[many] = _numbered(above[many] << 32 | size[many], next_symbol)
            else:
                right = _is_right(symbols, len(self.levels))
                starts[1:] = ~(right[1:] & ~right[:-1])
                begin = np.flatnonzero(starts)
                above, many = symbols[begin].copy(), np.diff(np.append(begin, n)) == 2
                first = begin[many]
                above[many] = _numbered(symbols[first] << 32 | symbols[first + 1], next_symbol)
            self.levels.append(Level(symbols, starts, blocks))
            next_symbol = max(next_symbol, int(above.max()) + 1)  # at most one for each symbol below: all stay under 2^31
            stale = stale + 1 if len(above) > 0.97 * n else 0
            symbols = above
        self.top = symbols

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from x on equal those from y on; x < y."""
        return self._extend(x, y, 1)

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before x equal those before y; x < y."""
        return self._extend(x, y, -1)

    def _extend(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """Places are cuts: place x lies before symbol x. Going left, the symbol that counts is the one before the place."""
        at = 0 if way == 1 else -1
        where = np.empty(len(x), dtype=np.int64)  # the place at which x ends
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who, x, y = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
        for level in self.levels:
            go, x, y = self._aligned(level, x, y, at, way)
            stopped.append((who[~go], x[~go], y[~go]))
            who, x, y = who[go], x[go], y[go]
            above = np.append(level.above, len(level.begin))
            x, y = above[x].astype(np.int64), above[y].astype(np.int64)
        x, y = self._along(self.top, x, y, at, way)
        for level, (more, mx, my) in zip(reversed(self.levels), reversed(stopped), strict=True):
            begin = np.append(level.begin, len(level.symbols))
            x, y = begin[x].astype(np.int64), begin[y].astype(np.int64)
            # symbols of the level above differ from here on, so at most a part of one is equal
            x, y = self._part(level, x, y, at, way)
            who, x, y = np.concatenate([who, more]), np.concatenate([x, mx]), np.concatenate([y, my])
        where[who] = x
        return where

    @staticmethod
    def _equal(symbols: np.ndarray, x: np.ndarray, y: np.ndarray, at: int) -> np.ndarray:
        """Whether the next symbols are equal; there is none before the first, and the last one is unlike all others."""
        equal = symbols[np.minimum(x + at, len(symbols) - 1)] == symbols[np.minimum(y + at, len(symbols) - 1)]
        return equal & (x > 0) if at else equal

    def _step(self, level: Level, x: np.ndarray, y: np.ndarray, at: int, way: int) -> np.ndarray:
        """How many equal next symbols lie in what is left of the shorter one of the two symbols above."""
        equal = self._equal(level.symbols, x, y, at)
        if not level.blocks:
            return equal.astype(np.int64)
        ax, ay = level.above[x + at], level.above[np.minimum(y + at, len(level.above) - 1)]
        rest = (
            np.minimum(level.end[ax] - x, level.end[ay] - y) if way == 1 else np.minimum(x - level.begin[ax], y - level.begin[ay])
        )
        return np.where(equal, rest, 0)

    def _aligned(self, level: Level, x, y, at: int, way: int):
        """Move on until both places are cuts of the level above; False where symbols differ before that."""
        go = np.ones(len(x), dtype=bool)
        off = np.flatnonzero(~(level.cut[x] & level.cut[y]))
        if len(off):
            x, y = x.copy(), y.copy()
            step = self._step(level, x[off], y[off], at, way)
            x[off] += way * step
            y[off] += way * step
            go[off] = level.cut[x[off]] & level.cut[y[off]] & (step > 0)
        return go, x, y

    def _part(self, level: Level, x, y, at: int, way: int):
        step = way * self._step(level, x, y, at, way)
        return x + step, y + step

    def _along(self, symbols: np.ndarray, x, y, at: int, way: int):
        """Symbol by symbol on the shortest level."""
        x, y = x.copy(), y.copy()
        left = np.arange(len(x))
        while len(left):
            left = left[self._equal(symbols, x[left], y[left], at)]
            x[left] += way
            y[left] += way
        return x, y


def _grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place and period of the grid of documents of ``n`` words, in portions."""
    periods = n // 2
    document = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(document)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (n[document] - 1) // period  # i and i + p inside the document
    ends = np.cumsum(pairs)
    first = 0
    while first < len(pairs):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CANDIDATES, side="right")))
        k = pairs[first:last]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        p = np.repeat(period[first:last], k)
        yield np.repeat(document[first:last], k), step * p, p
        first = last


def runs_of(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of all runs, by document, start and period.

    ``symbols`` are the words of all documents, numbered, each document followed by a number of its own.
    """
    grammar = Grammar(symbols)
    first = np.cumsum(lengths + 1) - (lengths + 1)
    found = [np.zeros((0, 4), dtype=np.int64)]
    for document, place, period in _grid(lengths):
        x = first[document] + place
        y = x + period
        # equal words at the pair, and at a neighbour: the stretch that agrees has six words or more
        kept = np.flatnonzero(symbols[x] == symbols[y])
        document, x, y, period = document[kept], x[kept], y[kept], period[kept]
        near = symbols[x + 1] == symbols[y + 1]
        near |= (x > 0) & (symbols[x - 1] == symbols[y - 1])
        document, x, y, period = document[near], x[near], y[near], period[near]
        end, start = grammar.right(x, y), grammar.left(x, y)
        length = end - start + period
        whole = length >= np.maximum(LEAST, 2 * period)
        rows = np.stack([document, start - first[document], length, period], axis=1)[whole]
        found.append(np.unique(rows, axis=0) if len(rows) else rows)
    rows = np.concatenate(found)
    # of one stretch the smallest period; others are its multiples
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of rows with about ``PORTION`` words."""
    first, held, n = 0, [], 0
    for row, text in enumerate(texts):
        words = words_of(text.as_py())
        if held and n + len(words) > PORTION:
            yield first, held
            first, held, n = row, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def _numbers(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[bytes, int] = {}
    parts = []
    for words in documents:
        parts.append([known.setdefault(w, len(known)) for w in words])
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    symbols = np.empty(lengths.sum() + len(parts), dtype=np.int64)
    first = 0
    for i, part in enumerate(parts):
        symbols[first : first + len(part)] = part
        symbols[first + len(part)] = len(known) + i
        first += len(part) + 1
    return lengths, symbols


def with_runs(docs: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """All columns of ``docs (text)``, ``runs`` (array of start, length, period) and ``collapsed``: the words joined by one
    space, without those that lie in a run behind its first period."""
    columns = [c for c in docs.columns if c not in (runs, collapsed)]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, documents in _portions(batch["text"]):
                lengths, symbols = _numbers(documents)
                document, start, length, period = runs_of(lengths, symbols)
                ends = np.searchsorted(document, np.arange(len(documents) + 1))
                structs = pa.StructArray.from_arrays(list(map(pa.array, (start, length, period))), names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                texts = []
                for i, words in enumerate(documents):
                    left = words
                    if ends[i] < ends[i + 1]:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        of = slice(ends[i], ends[i + 1])
                        np.add.at(edge, start[of] + period[of], 1)
                        np.add.at(edge, start[of] + length[of], -1)
                        left = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    texts.append(b" ".join(left))
                rows = batch["row"].slice(first, len(documents)).flatten()
                arrays = [*rows, lists, pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, runs, collapsed])

    fields = [*(docs.schema[c] for c in columns), T.StructField(runs, RUNS), T.StructField(collapsed, T.BinaryType())]
    sent = docs.select(kept, F.col("text").cast("binary").alias("text"))
    return sent.mapInArrow(find, T.StructType(fields)).withColumn(collapsed, F.col(collapsed).cast("string"))
