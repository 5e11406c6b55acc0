"""Join documents on the Jaccard similarity of their word n-grams with a MinHash LSH forest.

A document is the set of its runs of five lower-cased words (a shorter one is a single run). Documents with equal sets are one
class from the start. Every class has, for each tree of the forest, a label of ``DEPTH`` MinHash values; the sorted labels form a
prefix trie. Each class begins with its whole labels and shortens them one value at a time until a pair at the threshold shares one
of its nodes with the target probability. Trees in which the shorter prefix would lead into a crowded node come last, and the larger
the node the later: a class keeps long prefixes there and makes up for it where it is nearly alone. Below ``CROWD`` members
sizes do not count, or a class would avoid just the trees in which it meets the one text that it is like. It looks at all classes in the nodes where it stopped, however far those went. Meeting makes a star around the
smallest class of a node, so no node emits pairs.

Connected stars are candidates. They are verified exactly: the sets of a candidate group are compared in blocks of bounded
size, each task emitting links per class and a spanning forest, so neither a large group nor its pairs are gathered.

Nulls and ties: a null text, or one without words, links with nothing; null ids are kept and belong to classes like others, but
name none; a class is named by its smallest id; of rows that repeat an id and a text each has the same result. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, roots
from .grouped import groups
from .store import stored

N = 5
THRESHOLD = 0.8
RECALL = 0.999
"""The probability with which a pair at the threshold meets, for each of its two classes; pairs above it meet more often."""
TREES = 20
DEPTH = 7
LEAST = 5
"""The shortest prefix: with all trees at it a pair at the threshold misses with probability 0.0004."""
CROWD = 64
BLOCK_CLASSES = 256
REMEMBERED = 100_000
BLOCK_GRAMS = 1_000_000
_find = re.compile(r"\w+").findall
_random = np.random.default_rng(20240229)
_factors = _random.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams_of(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words if there are fewer."""
    words = _find((text or "").lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    length = min(n, len(h))
    out = np.zeros(len(h) - length + 1, dtype=np.uint64)
    for i in range(length):
        out = _mix(out + h[i : len(h) - length + 1 + i])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labels_of(grams: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each tree."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 4096):
        product = _factors[:, None] * grams[None, i : i + 4096]
        least = np.minimum(least, product.min(axis=1))
    return least.reshape(TREES, DEPTH)


def shortened(company: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """The depth at which a class stops in each tree. ``company`` are the members of its shared nodes by :func:`place_of` them."""
    def crowd(tree: int, depth: int) -> tuple[int, int, int]:
        """What going on from ``depth`` costs; level by level where it costs nothing."""
        return max(0, company.get(place_of(tree, depth - 1), 1) - CROWD), -depth, tree

    depths, missed = [DEPTH] * TREES, (1 - threshold**DEPTH) ** TREES
    cost = [crowd(t, DEPTH) for t in range(TREES)]
    heapq.heapify(cost)
    while missed > 1 - recall and cost:
        _, _, tree = heapq.heappop(cost)
        missed *= (1 - threshold ** (depths[tree] - 1)) / (1 - threshold ** depths[tree])
        depths[tree] -= 1
        if depths[tree] > LEAST:
            heapq.heappush(cost, crowd(tree, depths[tree]))
    return depths


def place_of(tree: int, depth: int) -> int:
    """Of a prefix among all prefixes of a class."""
    return tree * (DEPTH - LEAST + 1) + DEPTH - depth


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, set_id (null without words), prefixes: a hash of each prefix of its labels, at :func:`place_of` it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets, prefixes = [], []
                for text in part["text"].to_pylist():
                    grams = grams_of(text)
                    if not len(grams):
                        sets.append(None)
                        prefixes.append(None)
                        continue
                    sets.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    labels = labels_of(grams)
                    prefixes.append(
                        [xxhash.xxh3_64_intdigest(row[:k].tobytes()) - (1 << 63) for row in labels for k in range(DEPTH, LEAST - 1, -1)]
                    )
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["key"], pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "set_id", "prefixes"],
                )

    return docs.mapInArrow(sign, "doc_id long, key long, set_id binary, prefixes array<long>")


def _stars(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges between the classes in the nodes where any of them stops and the smallest class there."""
    nodes = classes.select("set_id", F.posexplode("prefixes").alias("place", "prefix"))
    shared = nodes.groupBy("place", "prefix").agg(F.min("set_id").alias("top"), F.count("*").alias("members")).where("members > 1")
    company = stored(nodes.join(shared, ["place", "prefix"]), "company")

    def stop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[int]] = {}
        for batch in batches:
            ids, places = [], []
            for set_id, met in zip(batch["set_id"].to_pylist(), batch["met"].to_pylist(), strict=True):
                sizes = {m["place"]: m["members"] for m in met}
                key = tuple(sorted(sizes.items()))
                if key not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[key] = [p for t, d in enumerate(shortened(sizes, recall=recall)) if (p := place_of(t, d)) in sizes]
                ids.extend([set_id] * len(known[key]))
                places.extend(known[key])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(places, pa.int32())], names=["set_id", "place"])

    # as many nodes as a class has prefixes, at most
    met = company.groupBy("set_id").agg(F.collect_list(F.struct("place", "members")).alias("met"))
    stops = met.mapInArrow(stop, "set_id binary, place int")
    visited = company.join(stops, ["set_id", "place"]).select("place", "prefix").distinct()
    edges = company.join(visited, ["place", "prefix"], "left_semi").where("set_id <> top")
    return edges.select(F.col("set_id").alias("a"), F.col("top").alias("b")).distinct()


def _verified(members: DataFrame) -> DataFrame:
    """``members (group, x, y, block, set_id, copies, grams)``, sorted by the first three: set_id, links, root."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["group", "x", "y"]):
            x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
            block = rows["block"].to_numpy()
            ids = rows["set_id"].to_pylist()
            copies = rows["copies"].to_numpy()
            linked = similar([np.frombuffer(g, dtype=np.uint64) for g in rows["grams"].to_pylist()])
            if x != y:  # pairs inside a block are compared where it meets itself
                linked &= block[:, None] != block[None]
            links = linked @ copies
            order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
            a, b = np.nonzero(np.triu(linked[np.ix_(order, order)], 1))
            root = order[roots(len(ids), a, b)]
            roots_of = dict(zip(order.tolist(), root.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(links, pa.int64()), pa.array([ids[roots_of[i]] for i in range(len(ids))], pa.binary())],
                names=["set_id", "links", "root"],
            )

    return members.mapInArrow(verify, "set_id binary, links long, root binary")


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more; exact."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[which]
    owner, which = owner[keep], column[which[keep]]
    common = np.zeros((n, n), dtype=np.float32)  # counts below 2^24 are exact
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    width = int(shared.sum())
    for start in range(0, width, 8192):
        a, b = np.searchsorted(which, [start, start + 8192])
        part = np.zeros((n, min(8192, width - start)), dtype=np.float32)
        part[owner[a:b], which[a:b] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None] - common
    out = common >= threshold * union
    np.fill_diagonal(out, False)
    return out


def _with_grams(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``grams``."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                grams = [grams_of(t).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["group"], part["set_id"], part["copies"], pa.array(grams, pa.binary())],
                    names=["group", "set_id", "copies", "grams"],
                )

    return rows.select("group", "set_id", "copies", "text").mapInArrow(
        gram, "group binary, set_id binary, copies long, grams binary"
    )


def classes_of(docs: DataFrame, threshold_recall: float = RECALL) -> DataFrame:
    """``docs (doc_id, text)`` to doc_id, key (hash of the text), class_id, n_links, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    signed = stored(_signed(rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    classes = stored(
        signed.where("set_id is not null").groupBy("set_id").agg(first, F.count("*").alias("copies"), F.first("prefixes").alias("prefixes")),
        "classes",
    )
    candidates = connected(_stars(classes, threshold_recall))
    chosen = (
        candidates.join(classes.select("set_id", "first", "copies"), F.col("node") == F.col("set_id"))
        .select(F.col("component").alias("group"), "set_id", "copies", "first.doc_id", "first.key")
        .alias("c")
    )
    texts = rows.alias("r").join(chosen, F.expr("r.doc_id <=> c.doc_id and r.key = c.key"))
    texts = texts.select("c.group", "c.set_id", "c.copies", "r.text")
    grams = stored(_with_grams(texts).dropDuplicates(["set_id"]), "grams")
    sizes = grams.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum(F.octet_length("grams")) / (8 * BLOCK_GRAMS))
        ).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = grams.join(sizes, "group").select("*", block.alias("block")).select("*", other)
    pairs = spread.select(
        "group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set_id", "copies", "grams"
    )
    found = stored(
        _verified(pairs.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")), "verified"
    )
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = connected(found.where("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    known = classes.select("set_id", "first", "copies").join(joined, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "first", "copies", F.coalesce("component", "set_id").alias("root")
    )
    named = known.groupBy("root").agg(F.min("first").alias("name"))
    known = known.join(named, "root").join(links, "set_id", "left").select(
        F.col("set_id").alias("s"), "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.join(known, F.col("set_id") == F.col("s"), "left").select(
        "doc_id",
        "key",
        F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("s").isNull(), True)
        .otherwise(F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("key") == F.col("name.key")))
        .alias("kept"),
    )
