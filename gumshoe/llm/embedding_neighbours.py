"""Link embeddings by cosine with cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms, three times each; its hash is the coordinate of the greatest
absolute value, with its sign. A table's bucket is the pair of hashes of two such rotations. A vector is put in its own bucket of
each table and also looks into the buckets that it nearly fell into (multiprobe). Vectors that meet are compared in double precision.

A pair that meets in several tables is counted in the first only, which both vectors' buckets tell, so tasks emit
links per vector and a spanning forest, never pairs. Buckets are compared in blocks, so a full bucket is not gathered.

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of
different lengths, or rows without id. Rows with the same vector are compared as one and counted as many. Rows that
share an id and differ in their vectors are items of their own. Numbers of any size count, as vectors are scaled before they are squared. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, roots
from .grouped import groups
from .store import stored

COSINE = 0.95
TABLES = 10
PROBES = 2
BLOCK = 1024
SEED = 90


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotated(x: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """``x`` with a power of two columns, after three rounds of sign flips and Hadamard transform."""
    n, d = x.shape
    for _ in range(3):
        x = x * random.choice(np.array([-1.0, 1.0]), d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            h *= 2
        x = x.reshape(n, d) / np.sqrt(d)
    return x


def buckets_of(x: np.ndarray) -> np.ndarray:
    """For each vector and table its bucket, and then those to look into, likeliest first."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, size - d))], axis=1)
    random = np.random.default_rng(SEED + size)
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, next_, loss = [], [], []
        for _ in range(2):
            y = rotated(x, random)
            a = np.abs(y)
            first = a.argmax(axis=1)
            top = a[rows, first]
            a[rows, first] = -1
            second = a.argmax(axis=1)
            loss.append(top - a[rows, second])
            best.append(2 * first + (y[rows, first] > 0))
            next_.append(2 * second + (y[rows, second] > 0))
        probes = np.stack([next_[0] * 2 * size + best[1], best[0] * 2 * size + next_[1]], axis=1)
        probes[loss[1] < loss[0]] = probes[loss[1] < loss[0]][:, ::-1]
        out[:, t, 0] = best[0] * 2 * size + best[1]
        out[:, t, 1:] = probes[:, :PROBES]
    return out


def _hashed(vectors: DataFrame) -> DataFrame:
    """A row for each vector, table and bucket: table, bucket, at_home, id, copies, vector, homes, probes."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["vector"].value_lengths().to_numpy()
            for d in np.unique(lengths):
                rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
                for part in (rows.slice(i, 2000) for i in range(0, rows.num_rows, 2000)):
                    x = part["vector"].flatten().to_numpy().astype(np.float64).reshape(-1, d)
                    b = buckets_of(unit(x))
                    own = pa.FixedSizeListArray.from_arrays(pa.array(b.reshape(-1)), TABLES * (1 + PROBES)).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [part["id"], part["copies"], part["vector"], own], names=["id", "copies", "vector", "buckets"]
                    )

    return vectors.mapInArrow(hash_, f"id long, copies long, vector {dict(vectors.dtypes)['vector']}, buckets array<long>")


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """Compare the rows of each bucket pair of blocks: id, links, root."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["table", "bucket", "d", "x", "y"]):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            x, y, t = g["x"][0].as_py(), g["y"][0].as_py(), g["table"][0].as_py()
            home, block = g["at_home"].to_numpy(), g["block"].to_numpy()
            if not home.any():
                continue
            ids, copies = g["id"].to_numpy(), g["copies"].to_numpy()
            v = unit(np.stack(g["vector"].to_pylist()).astype(np.float64))
            a, b = np.nonzero(v @ v[home].T >= cosine)
            b = np.flatnonzero(home)[b]
            both = home[a] & home[b]
            keep = (ids[a] != ids[b]) & (~both | (ids[a] < ids[b]))
            keep &= block[a] == block[b] if x == y else block[a] != block[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            buckets = np.stack(g["buckets"].to_pylist()).reshape(len(ids), TABLES, 1 + PROBES)
            keep = _first(buckets, ids, a, b, t, home)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            links = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
            order = np.argsort(ids)
            place = np.empty_like(order)
            place[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), place[a], place[b])][place]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["id", "links", "root"]
            )

    return rows.mapInArrow(compare, "id long, links long, root long")


def _first(buckets, ids, a, b, table: int, home) -> np.ndarray:
    """Whether this meeting is the one at which the pair (a, b) counts: the first table, by home, then by the smaller id's look."""
    p, q = buckets[a], buckets[b]
    same = p[:, :, 0] == q[:, :, 0]
    a_looks = (p[:, :, 1:] == q[:, :, :1]).any(axis=2)
    b_looks = (q[:, :, 1:] == p[:, :, :1]).any(axis=2)
    first = (same | a_looks | b_looks).argmax(axis=1) == table
    at_home = same[:, table]
    smaller_looks = np.where(ids[a] < ids[b], a_looks[:, table], b_looks[:, table])
    # here a looks into b's bucket, or both are at home
    here = np.where(home[a], at_home, ~at_home & ((ids[a] < ids[b]) | ~smaller_looks))
    return first & here


def neighbours(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors (vec_id, embedding)`` to vec_id, n_links, component_id, kept."""
    # as they come: only floats are kept as floats
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda c: c != 0)
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    distinct = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")
    hashed = stored(_hashed(distinct.repartition("id").select("id", "copies", "vector")), "hashed")
    at = F.explode(F.sequence(F.lit(0), F.lit(TABLES * (1 + PROBES) - 1))).alias("at")
    placed = hashed.select("*", at).select(
        F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("table"),
        F.expr("buckets[at]").alias("bucket"),
        F.size("vector").alias("d"),
        (F.col("at") % (1 + PROBES) == 0).alias("at_home"),
        "id",
    )
    bucket = ["table", "bucket", "d"]
    full = placed.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("at_home").alias("held")).where("n > 1 and held")
    full = full.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = placed.join(full, bucket).select("*", block.alias("block"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(hashed, "id")
    pairs = met.select(
        *bucket, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "at_home", "id", "copies", "vector", "buckets"
    )
    keys = [*bucket, "x", "y"]
    found = stored(_linked(pairs.repartition(*keys).sortWithinPartitions(*keys), cosine), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        distinct.select("vector", "vec_id", "id", "copies")
        .join(links, "id", "left")
        .join(joined, F.col("id") == F.col("node"), "left")
        .select("vector", "vec_id", F.coalesce("component", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    first = known.groupBy("root").agg(F.min("vec_id").alias("first"))
    known = known.drop("vec_id").join(first, "root")
    named = rows.join(known, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", "vec_id").alias("component_id")
    )
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
