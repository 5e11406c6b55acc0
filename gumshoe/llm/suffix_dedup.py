"""Remove byte strings that occur earlier in the corpus, by interval expansion on Burrows-Wheeler transforms.

Every string of ``LENGTH`` bytes belongs to the smallest hash of the ``K``-byte strings in it; equal strings belong to the same.
Consecutive strings of a document with the same smallest hash are a run. Only runs whose hash is found at two places can repeat:
their different texts are brought together by hash, and each block of them is one string collection.

In a block, the Burrows-Wheeler transform is extended backwards breadth first: the intervals of all strings of one byte, then of two, and
so on. Where an interval of strings of l bytes ends for the first time, the suffixes on both sides share exactly l - 1 bytes. After
``LENGTH`` steps the ends that are left share at least ``LENGTH`` bytes, so the suffixes between set ends are the places of one string.
The earliest place of each string stays; every other start in a run is removed.

Runs that are equal are one row before anything is gathered, and a run that shares its hash with no other text needs no transform. A hash with very many different runs is split by the strings
themselves. The hashes that repeat go to the documents as a bitmap of fixed size, which only spares work: the join behind
it is exact.

Order: ids ascending, null ids last, then a hash of the row, then the start. Nulls and ties: a null text is empty; rows that repeat an
id and a text are one document and get the same result; texts below ``LENGTH`` bytes keep everything. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import groups
from .store import stored

LENGTH = 100
K = 32
SPAN = LENGTH - K + 1
LONGEST_RUN = 4096
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19
HOT_TEXTS = 20_000
SEPARATOR = 0xFF
"""A byte that UTF-8 does not use."""
BITMAP_BITS = 1 << 26
_table = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64)
_p = [pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in (1, 2, 4, 8, 16)]


def hashes_of(data: np.ndarray) -> np.ndarray:
    """Of all ``K``-byte strings."""
    h = _table[data]
    for p, n in zip(_p, (1, 2, 4, 8, 16), strict=True):
        h = h[:-n] * np.uint64(p) + h[n:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding(f, x: np.ndarray, span: int) -> np.ndarray:
    n = 1
    while 2 * n <= span:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (span - n)], x[span - n :]) if span > n else x


class Chunk:
    """Some documents behind one another, and their runs."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.count, self.start, self.owner, self.hash = (np.empty(0, dtype=np.int64) for _ in range(4))
        self.hashes = np.empty(0, dtype=np.uint64)
        if len(self.data) < LENGTH:
            return
        self.hashes = hashes_of(self.data)
        self.least = sliding(np.minimum, self.hashes, SPAN)
        n = len(self.least)
        self.inside = np.zeros(n + 1, dtype=bool)  # starts whose string does not leave its document
        edge = np.zeros(n + 1, dtype=np.int8)
        long = self.lengths >= LENGTH
        np.add.at(edge, self.first[long], 1)
        np.add.at(edge, self.first[long] + self.lengths[long] - LENGTH + 1, -1)
        self.inside[:n] = np.cumsum(edge[:n]) > 0
        inside = self.inside[:n]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (self.least[1:] != self.least[:-1])
        start = np.flatnonzero(begins)
        # a run ends before the next one begins, or where the document's starts end
        ends = np.flatnonzero(inside & ~self.inside[1:])
        stop = np.minimum(np.append(start[1:], n), ends[np.searchsorted(ends, start)] + 1)
        count = stop - start
        if len(count) and count.max() > LONGEST_RUN:
            pieces = -(-count // LONGEST_RUN)
            inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stop = np.repeat(stop, pieces)
            start = np.repeat(start, pieces) + inner * LONGEST_RUN
            count = np.minimum(stop - start, LONGEST_RUN)
        self.start, self.count = start, count
        self.owner = np.searchsorted(self.first, start, side="right") - 1
        self.hash = self.least[start].view(np.int64)

    def anchors(self) -> np.ndarray:
        """The places of the smallest hashes."""
        if not len(self.start):
            return self.start
        n = len(self.least)
        edge = np.zeros(SPAN - 1, np.uint64)
        most = sliding(np.maximum, np.concatenate([edge, np.where(self.inside[:n], self.least, 0), edge]), SPAN)
        return np.flatnonzero((self.hashes == most) & (most > 0))  # most: over the strings that hold a place

    def repeats(self, keep: np.ndarray) -> np.ndarray:
        """Whether a run holds its hash at two places, and so perhaps one string twice."""
        at = self.anchors()
        values, code = np.unique(self.hashes[at].view(np.int64), return_inverse=True)
        key = np.sort(code << 32 | at)
        code = np.searchsorted(values, self.hash[keep]) << 32
        start = self.start[keep]
        return np.searchsorted(key, code | (start + self.count[keep] + SPAN - 1)) - np.searchsorted(key, code | start) > 1


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[list], Chunk, list[bytes]]]:
    held, texts, size = [], [], 0
    for batch in batches:
        for text, *rest in zip(*(batch[c].to_pylist() for c in ["text", *columns]), strict=True):
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            held.append(rest)
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield held, Chunk(texts), texts
                held, texts, size = [], [], 0
    if texts:
        yield held, Chunk(texts), texts


def repeated_hashes(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, _ in chunks(batches, []):
            values, n = np.unique(chunk.hashes[chunk.anchors()].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["hash", "n"])

    found = rows.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return stored(found.where("n > 1").select("hash"), "hashes")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """``BITMAP_BITS`` bits, set at the hashes' lower bits."""
    at = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1  # Spark counts from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in parts.collect():  # of fixed size whatever the input
        begin = (row["part"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def bit_of(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (BITMAP_BITS - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def runs_of(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """hash, text_id, doc_id, rid, start, n, repeats: the runs whose hash is found at two places."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(hashes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, chunk, texts in chunks(batches, ["rid", "doc_id"]):
            keep = bit_of(sent.value, chunk.hash)
            owner = chunk.owner[keep]
            start, count = chunk.start[keep], chunk.count[keep]
            data = chunk.data.tobytes()
            ids = [xxhash.xxh3_64_intdigest(data[i:j]) - (1 << 63) for i, j in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
            rid = np.array([r[0] for r in held], dtype=np.int64)[owner]
            doc_id = pa.array([r[1] for r in held], pa.int64()).take(pa.array(owner))
            arrays = [
                pa.array(chunk.hash[keep]), pa.array(ids, pa.int64()), doc_id, pa.array(rid),
                pa.array((start - chunk.first[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(chunk.repeats(keep)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "text_id", "doc_id", "rid", "start", "n", "repeats"])

    schema = "hash long, text_id long, doc_id long, rid long, start int, n int, repeats boolean"
    found = rows.select("rid", "doc_id", "text").mapInArrow(find, schema)
    return stored(found.join(hashes, "hash", "left_semi"), "runs")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of at least their first ``depth`` bytes."""
    n = len(data)
    key = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes in one number
        key = key[:-step] << np.uint64(8 * step) | key[step:]
    key, known = key[:n], 8
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        key = rank << np.uint64(32)
        key[: n - known] |= rank[known:] + np.uint64(1)
        known *= 2


def string_classes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``data``, texts that each end with ``SEPARATOR``, and a class number for each entry.

    Entries with at least ``length`` bytes before the next separator are of one class if and only if these are equal.
    """
    n = len(data)
    order = suffix_array(data, length)
    before = data[order - 1]  # the transform; the last byte stands before the first
    by_letter = np.argsort(before, kind="stable")
    back = np.empty(n, dtype=np.int64)  # an entry to that of the suffix one byte longer
    back[by_letter] = np.arange(n)
    begins_with = data[order]
    ends = np.zeros(n + 1, dtype=bool)  # where neighbours are known to share less than ``length`` bytes
    ends[[0, n]] = True
    counts = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=256))])
    left, right = counts[:-1][np.diff(counts) > 0], counts[1:][np.diff(counts) > 0]
    for _ in range(length):
        # an interval that ends where a shorter string's did has only extensions that end where that one's do
        new = ~ends[right]
        left, right = left[new], right[new]
        if not len(left):
            break
        ends[right] = True
        single = right - left == 1
        at = left[single]
        at = at[before[at] != SEPARATOR]
        left, right = left[~single], right[~single]
        width = right - left
        which = np.repeat(np.arange(len(left)), width)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + left[which]
        inside, which = inside[before[inside] != SEPARATOR], which[before[inside] != SEPARATOR]
        # the entries one byte longer lie side by side for each interval and byte
        longer = np.sort(back[inside] << 32 | which)
        place, which = longer >> 32, longer & 0xFFFFFFFF
        letter = begins_with[place]
        new = np.ones(len(place) + 1, dtype=bool)
        new[1:-1] = (np.diff(place) != 1) | (np.diff(which) != 0) | (letter[1:] != letter[:-1])
        left = np.concatenate([back[at], place[new[:-1]]])
        right = np.concatenate([back[at], place[new[1:]]]) + 1
    return order, np.cumsum(ends[:n])


def first_places(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, offset and count of the starts in ``texts`` at which a string has its earliest place.

    ``doc`` ranks the documents of the texts' earliest places, ``start`` is where they begin there.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    end = bytes([SEPARATOR])
    data = np.frombuffer(end.join(texts) + end, dtype=np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    order, classes = string_classes(data, LENGTH)
    number = np.searchsorted(begin, order, side="right") - 1
    offset = order - begin[number]
    full = offset + LENGTH <= lengths[number]
    number, offset, classes = number[full], offset[full], classes[full]
    key = doc[number] << 32 | (start[number] + offset)
    begins = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    least = np.repeat(np.minimum.reduceat(key, begins), np.diff(np.append(begins, len(key))))
    kept = key == least
    place = np.sort(begin[number[kept]] + offset[kept])
    new = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))
    number = np.searchsorted(begin, place[new], side="right") - 1
    return number, place[new] - begin[number], np.diff(np.append(new, len(place)))


def different_texts(runs: DataFrame) -> DataFrame:
    """A row for each hash and text of ``runs``: n, its earliest place, and how many texts share the hash."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid", "start")
    texts = runs.groupBy("hash", "text_id").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("repeats").alias("repeats"))
    texts = stored(texts, "texts")
    per = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.max("repeats").alias("any_repeats"))
    texts = texts.join(per, "hash").select("hash", "first.*", "n", "texts", "any_repeats")
    return stored(texts, "texts")


def cut_texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``text`` to ``places (hash, texts, unnamed, doc_id, rid, start, n)``, from the documents."""
    lists = places.groupBy("rid").agg(F.collect_list(F.struct("hash", "texts", "start", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                out = []
                lists = fields(part["runs"])
                for rid, doc_id, text, run in zip(*(part[c].to_pylist() for c in ("rid", "doc_id", "text")), lists, strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    out += [
                        (hash_, texts, data[start : start + n + LENGTH - 1], doc_id is None, doc_id, rid, start)
                        for hash_, texts, start, n in zip(*(x.tolist() for x in run), strict=True)
                    ]
                columns = list(zip(*out, strict=True)) or [[]] * 7
                types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
                names = ["hash", "texts", "text", "unnamed", "doc_id", "rid", "start"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    # a row that repeats an id and a text is cut once more, with the same places
    found = rows.join(lists, "rid").select("rid", "doc_id", "text", "runs")
    return found.mapInArrow(cut, "hash long, texts long, text binary, unnamed boolean, doc_id long, rid long, start int")


def split_hot(texts: DataFrame) -> DataFrame:
    """Add ``sub``: 0, or where a hash has very many texts, a part of its strings, which then stand alone."""
    hot = F.col("texts") > HOT_TEXTS
    last = F.when(hot, F.length("text") - LENGTH).otherwise(0)
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    string = F.when(hot, F.expr(f"substring(text, at + 1, {LENGTH})")).otherwise(F.col("text"))
    rows = rows.select("hash", "texts", string.alias("text"), "unnamed", "doc_id", "rid", (F.col("start") + F.col("at")).alias("start"))
    parts = F.pmod(F.xxhash64("text"), F.ceil(F.col("texts") * SPAN / HOT_TEXTS)) + 1
    return rows.select("hash", F.when(hot, parts).otherwise(0).alias("sub"), "text", "unnamed", "doc_id", "rid", "start")


def earliest(texts: DataFrame) -> DataFrame:
    """rid, start, n: starts in runs at which a string has its earliest place."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups(batches, ["hash", "sub"]):
            held.append(group)
            size += group["text"].nbytes
            if size >= BLOCK_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables)
        texts, rid = rows["text"].to_pylist(), rows["rid"].to_numpy()
        start = rows["start"].to_numpy().astype(np.int64)
        unnamed = rows["unnamed"].to_numpy()
        doc_id = rows["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort([rid, doc_id, unnamed])
        new = np.concatenate([[True], (np.diff(doc_id[order]) != 0) | (np.diff(rid[order]) != 0)])
        doc = np.empty(len(texts), dtype=np.int64)
        doc[order] = np.cumsum(new)
        number, offset, count = first_places(texts, doc, start)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[number]), pa.array((start[number] + offset).astype(np.int32)), pa.array(count.astype(np.int32))],
            names=["rid", "start", "n"],
        )

    rows = split_hot(texts)
    return rows.repartition("hash", "sub").sortWithinPartitions("hash", "sub").mapInArrow(expand, "rid long, start int, n int")


def fields(lists: pa.Array) -> Iterator[list[np.ndarray]]:
    """The fields of a list of structs as arrays, row by row; a null list is empty."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
    columns = [c.to_numpy() for c in lists.flatten().flatten()]
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        yield [c[begin:end] for c in columns]


def removed_starts(n: int, runs: list[np.ndarray], kept: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int32)
    for (at, count), sign in ((runs, 1), (kept, -1)):
        np.add.at(change, at, sign)
        np.add.at(change, at + count, -sign)
    return np.cumsum(change[:n]) > 0


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs (doc_id, text)`` to doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if wanted the bytes that stay, ``kept``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    long = rows.where(F.octet_length("text") >= LENGTH)
    runs = runs_of(long, repeated_hashes(long))
    texts = different_texts(runs)
    # a text that shares its hash with no other, and is not periodic, is a collection of one string: its only place stays
    alone = (F.col("texts") == 1) & ~F.col("any_repeats")
    settled = texts.where(alone).select("rid", "start", "n")
    expanded = earliest(cut_texts(rows, texts.where(~alone)))
    kept = settled.unionByName(expanded).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("kept"))
    lists = runs.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                both = zip(fields(part["runs"]), fields(part["kept"]), strict=True)
                for doc_id, text, (runs, kept) in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), both, strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    gone, spans, left = 0, 0, data
                    if len(runs[0]):
                        starts = removed_starts(len(data), runs, kept)
                        edge = np.flatnonzero(np.diff(starts, prepend=False, append=False))
                        change = np.zeros(len(data) + LENGTH, dtype=np.int32)
                        np.add.at(change, edge[::2], 1)
                        np.add.at(change, edge[1::2] + LENGTH - 1, -1)
                        drop = np.cumsum(change[: len(data)]) > 0
                        gone, spans = int(drop.sum()), int((drop & ~np.append(False, drop[:-1])).sum())
                        left = np.frombuffer(data, dtype=np.uint8)[~drop].tobytes()
                    out.append((doc_id, len(data), gone, spans, hashlib.sha256(left).hexdigest(), left))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:-1], names=names if with_text else names[:-1])

    found = rows.join(lists, "rid", "left").join(kept, "rid", "left").select("doc_id", "text", "runs", "kept")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.mapInArrow(remove, schema + (", kept binary" if with_text else ""))
