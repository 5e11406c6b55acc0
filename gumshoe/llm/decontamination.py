"""Find benchmark passages in training documents with a distributed positional inverted index.

The index is a stored table with one row per shard: a run of whole documents of one input task, up to a fixed number of
words. A shard holds its terms, the ascending word places of each, and its documents, which lie one behind the other with
a gap so that no phrase reaches into the next. Postings are made where the documents are read and searched where
the shard is read, so nothing is shuffled, and a frequent term or passage is spread over the shards. A row group holds
few shards, as Spark decodes a whole one at a time.

A phrase is searched from its rarest terms: the list of the term that is rarest in the shard, moved back by its offset in
the phrase, is intersected with the moved list of the next rarest, and so on while anything is left. Phrases are sent to
the shards in blocks of bounded size, as arrays of term numbers: every worker holds them all.

Words: A-Z is lower-cased, and words are the runs of ``WORD``. Nulls and ties: a null text has no words; items without
words have no phrase; null document ids are kept; null item ids match but are not counted; rows that repeat an id are
separate documents, and items that repeat an id are one item. Empty tables give an empty result, or documents without
hits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 10
GAP = 64
SHARD_WORDS = 1 << 18
SHARDS_A_GROUP = 2
"""Shards in a row group of the stored index; decoded one takes 2 to 4 MB."""
BLOCK_PHRASES = 50_000
PLACES = 1 << 20
"""Places of rarest terms from which a shard is searched at a time, or those of one phrase."""
INDEX = pa.schema(
    [
        ("shard", pa.int64()),
        ("terms", pa.list_(pa.string())),
        ("ends", pa.list_(pa.int32())),
        ("places", pa.list_(pa.int32())),
        ("doc_id", pa.list_(pa.int64())),
        ("key", pa.list_(pa.int64())),
        ("first", pa.list_(pa.int32())),
        ("n_words", pa.list_(pa.int32())),
    ]
)

_find = re.compile(WORD).findall
_lower = str.maketrans(UPPER, LOWER)


def words_of(text: str | None) -> list[str]:
    return _find((text or "").translate(_lower))


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shard(number: int, ids: list, keys: list, texts: list[list[str]]) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]])
    words = pa.chunked_array([pa.array(t, pa.string()) for t in texts], pa.string())
    coded = pa.concat_arrays(words.chunks).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    places = np.arange(len(codes)) + np.repeat(np.arange(len(ids)) * GAP, lengths)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    lists = (coded.dictionary, ends, places[order], ids, keys, first, lengths)
    arrays = [pa.array([number], pa.int64())]
    for values, field in zip(lists, list(INDEX)[1:], strict=True):
        values = values if isinstance(values, pa.Array) else pa.array(values, field.type.value_type)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(field.type.value_type)))
    return pa.RecordBatch.from_arrays(arrays, schema=INDEX)


def build_index(docs: DataFrame) -> DataFrame:
    """Index ``docs (doc_id, text)`` and store the index."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, keys, texts, held = [], [], [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                words = words_of(text)
                if ids and held + len(words) > SHARD_WORDS:
                    yield _shard(number, ids, keys, texts)
                    number += 1
                    ids, keys, texts, held = [], [], [], 0
                ids.append(doc_id)
                keys.append(key)
                texts.append(words)
                held += len(words) + GAP
        if ids:
            yield _shard(number, ids, keys, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    schema = (
        "shard long, terms array<string>, ends array<int>, places array<int>, "
        "doc_id array<long>, key array<long>, first array<int>, n_words array<int>"
    )
    return stored(rows.mapInArrow(index, schema), "postings", SHARDS_A_GROUP)


class Shard:
    """One row of the index in a task."""

    def __init__(self, row: dict) -> None:
        self.terms = row["terms"]
        self.ends = np.concatenate([[0], row["ends"].to_numpy()]).astype(np.int64)
        self.counts = np.diff(self.ends)
        self.places = row["places"].to_numpy().astype(np.int64)
        # term and place in one ascending number: a list is a range, and a place in it is one binary search
        self.sorted = np.repeat(np.arange(len(self.counts)), self.counts) << 32 | self.places
        self.ids, self.keys = row["doc_id"].to_pylist(), row["key"].to_numpy()
        self.first, self.n_words = row["first"].to_numpy().astype(np.int64), row["n_words"].to_numpy().astype(np.int64)

    def codes(self, terms: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def holds(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = codes << 32 | places
        at = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
        return (self.sorted[at] == wanted) & (places >= 0)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


class Phrases:
    """A block of phrases as a table of term numbers, -1 behind the end of short ones, and the items of each, if they have any."""

    def __init__(self, rows: pa.Table) -> None:
        """Of ``rows (terms, items)``; items may be left out."""
        self.length, self.vocabulary, codes = _coded(rows["terms"])
        self.table = np.full((len(self.length), int(self.length.max(initial=0))), -1, dtype=np.int32)
        self.table[np.arange(self.table.shape[1]) < self.length[:, None]] = codes
        if "items" in rows.column_names:
            n, self.items, self.item = _coded(rows["items"])
            self.ends = np.concatenate([[0], np.cumsum(n)])

    def terms(self, i: int) -> list[str]:
        return self.vocabulary.take(pa.array(self.table[i, : self.length[i]])).to_pylist()

    def items_of(self, which: np.ndarray) -> list[str]:
        """The items of some phrases, each once."""
        found = np.unique(np.concatenate([self.item[self.ends[i] : self.ends[i + 1]] for i in which]))
        return self.items.take(pa.array(found)).to_pylist()

    def search(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and start places of all occurrences."""
        codes = np.append(shard.codes(self.vocabulary), -2)[self.table]
        left = np.flatnonzero((codes != -1).all(axis=1))
        if not len(left) or not len(shard.sorted):
            return left[:0], left[:0]
        codes = codes[left]
        counts = np.where(codes < 0, np.iinfo(np.int64).max, shard.counts[codes])
        rarest = np.argsort(counts, axis=1, kind="stable")
        turn = np.cumsum(np.take_along_axis(counts, rarest[:, :1], axis=1)[:, 0]) // PLACES
        found = []
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(turn)) + 1):
            which, start = _occurrences(shard, codes[part], rarest[part])
            found.append((left[part[which]], start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _coded(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lists of texts as their lengths, the distinct texts and the number of each text."""
    lists = lists.combine_chunks()
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _occurrences(shard: Shard, codes: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``codes`` and start place of each occurrence; ``rarest`` has the offsets of each row's terms, the rarest first."""
    offset, code = rarest[:, 0], np.take_along_axis(codes, rarest[:, :1], axis=1)[:, 0]
    n = shard.counts[code]
    which = np.repeat(np.arange(len(codes)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = shard.places[np.repeat(shard.ends[code], n) + inside] - offset[which]
    for step in range(1, codes.shape[1]):
        offset = rarest[which, step]
        code = codes[which, offset]
        kept = (code < 0) | shard.holds(np.maximum(code, 0), start + offset)
        which, start = which[kept], start[kept]
    return which, start


def phrases_of(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``items (item_id, text)`` to terms, items (array of ids): all windows of ``length`` words, or the whole item."""
    words = items.select("item_id", words_column(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))).alias("start")
    windows = words.select("item_id", "words", starts).select(
        F.col("item_id").cast("string").alias("item_id"), F.slice("words", F.col("start") + 1, length).alias("terms")
    )
    return windows.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def blocks_of(phrases: DataFrame) -> list[Broadcast]:
    """Phrases in blocks of about ``BLOCK_PHRASES``, sent one after the other."""
    phrases = stored(phrases, "phrases")
    n = -(-phrases.count() // BLOCK_PHRASES)
    parts = (phrases.where(F.pmod(F.xxhash64("terms"), F.lit(n)) == i).toArrow() for i in range(n))
    return [phrases.sparkSession.sparkContext.broadcast(Phrases(rows)) for rows in parts]


def over_shards(index: DataFrame, schema: str, report: Callable[[Shard], Iterator[pa.RecordBatch]]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from report(Shard({name: batch[name][i].values for name in batch.schema.names[1:]}))

    return index.mapInArrow(search, schema)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, start (word number), terms: every exact occurrence of ``phrases (terms, items)``."""
    blocks = blocks_of(phrases)

    def report(shard: Shard) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            which, start = block.value.search(shard)
            at = shard.document_of(start)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.ids[i] for i in at], pa.int64()),
                    pa.array(start - shard.first[at], pa.int64()),
                    pa.array([block.value.terms(i) for i in which], pa.list_(pa.string())),
                ],
                names=["doc_id", "start", "terms"],
            )

    return over_shards(index, "doc_id long, start long, terms array<string>", report)


def near_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """doc_id, start, n_words, terms: the shortest spans of at most ``within`` words that hold all of ``queries.terms``.

    Spans are looked for around every place of the query's rarest term; spans that contain another are left out.
    """
    if within > GAP:
        raise ValueError(f"within is at most {GAP}")
    blocks = blocks_of(queries)

    def spans(shard: Shard, terms: list[str]) -> set[tuple[int, int]]:
        codes = shard.codes(pa.array(sorted(set(terms)), pa.string()))
        if (codes < 0).any():
            return set()
        lists = sorted((shard.places[shard.ends[c] : shard.ends[c + 1]] for c in codes), key=len)
        found = set()
        for place in lists[0]:
            around = [x[np.searchsorted(x, place - within + 1) : np.searchsorted(x, place + within)] for x in lists]
            for start in {int(p) for x in around for p in x if p <= place}:
                after = [x[np.searchsorted(x, start) :] for x in around]
                if all(len(x) for x in after):
                    end = max(int(place), *(int(x[0]) for x in after[1:]), int(place))
                    if end - start < within:
                        found.add((start, end))
        return {a for a in found if not any(b != a and a[0] <= b[0] and b[1] <= a[1] for b in found)}

    def report(shard: Shard) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            queried = (block.value.terms(i) for i in range(len(block.value.length)))
            rows = [(s, e, terms) for terms in queried for s, e in sorted(spans(shard, terms))]
            at = shard.document_of(np.array([r[0] for r in rows], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.ids[i] for i in at], pa.int64()),
                    pa.array([int(r[0] - shard.first[i]) for r, i in zip(rows, at, strict=True)], pa.int64()),
                    pa.array([r[1] - r[0] + 1 for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                names=["doc_id", "start", "n_words", "terms"],
            )

    return over_shards(index, "doc_id long, start long, n_words long, terms array<string>", report)


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, key (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs)
    blocks = blocks_of(phrases_of(items, length))

    def report(shard: Shard) -> Iterator[pa.RecordBatch]:
        edge = np.zeros(int(shard.first[-1] + shard.n_words[-1]) + 2, dtype=np.int64)
        items_of: dict[int, set] = {}
        for block in blocks:
            phrases = block.value
            which, start = phrases.search(shard)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + phrases.length[which], -1)
            document = shard.document_of(start)
            order = np.argsort(document, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(document[order])) + 1) if len(order) else ():
                items_of.setdefault(int(document[at[0]]), set()).update(phrases.items_of(np.unique(which[at])))
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        n_hit = covered[shard.first + shard.n_words] - covered[shard.first]
        lists = [sorted(items_of.get(i, ())) for i in range(len(shard.ids))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard.ids, pa.int64()),
                pa.array(shard.keys, pa.int64()),
                pa.array(shard.n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in lists], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
                pa.array(n_hit > 0),
            ],
            names=["doc_id", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = "doc_id long, key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return over_shards(index, schema, report)
