"""Mix sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The
documents of a source are put in a fixed order; the running sum of expected copies plus one
offset in [0, 1) crosses integers, and a document is taken once for each integer it crosses.

The order is (whole part of the square root of the size, MD5 of the id, the id, the size): as
neighbours have about the same size, the words that are taken stay close to the target, and the
MD5 splits a source of any size into strips that sort alone. Only counts are shuffled between them.

Nulls and ties: a null text has size 0; a null source is a source of its own, after the others;
null ids sort first among equal digests (as the digest of ""); rows that repeat all of this are
interchangeable. A source of size 0 has target 0 and nothing is taken. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
STRIP_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``sizes (source, size)``: source, source_size, target.

    Targets share ``total`` times all sizes by weight and stop at ``most`` times their source's size. Sharing the
    excess again until none is above ends at min(limit, level * weight); sources fill up in the order of
    limit / weight, so running sums in that order give the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * F.lit(most))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if all sources before this one are full and this one is not
    level = (F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    per = per.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    settled = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return per.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(settled * F.col("weight")).cast("double").alias("target"),
    )


def drawn_offset(seed: int | str, source: Column) -> Column:
    """A number in [0, 1) for each source: the first 48 bits of the MD5 of the seed and the source's name; no name is empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def systematic(rows: DataFrame, offset: float | Column) -> DataFrame:
    """Add ``copies`` to ``rows (doc_id, size, source, source_size, target, key)``."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = (
        rows.withColumn("class", F.floor(F.sqrt(F.col("size"))))
        .withColumn("digest", digest)
        .withColumn("strip", F.substring("digest", 1, STRIP_DIGITS))
    )
    strips = rows.groupBy("source", "class", "strip").agg(F.count("*").alias("n"))
    classes = rows.groupBy("source", "class").agg(F.count("*").alias("n_class"))
    in_class = Window.partitionBy("source", "class").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.withColumn("strips_before", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    classes = classes.withColumn("classes_before", F.coalesce(F.sum("n_class").over(in_source), F.lit(0)))
    alone = Window.partitionBy("source", "class", "strip").orderBy("digest", "doc_id", "size", "key")
    ranked = rows.withColumn("rank", F.row_number().over(alone))
    s, c, r = strips.alias("s"), classes.alias("c"), ranked.alias("r")
    at = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    both = s.join(c, at("s", "c", "source", "class")).select(
        "s.source", "s.class", "s.strip", (F.col("strips_before") + F.col("classes_before")).alias("before")
    )
    placed = r.join(both.alias("b"), at("r", "b", "source", "class", "strip")).select(
        *[F.col(f"r.{n}") for n in ("doc_id", "size", "source", "source_size", "target", "key")],
        (F.col("before") + F.col("rank")).alias("place"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cross = lambda place: F.floor(place * rate + (offset if isinstance(offset, Column) else F.lit(offset)))
    return placed.withColumn("copies", cross(F.col("place")) - cross(F.col("place") - 1))


def mix(
    sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, offset: float = 0.5, seed: int | str | None = None
) -> DataFrame:
    """``sizes (doc_id, source, size, key)`` to these and source_size, target, copies, taken.

    ``key`` tells rows of one id apart. The offset is the one random number of a source's sample: with a ``seed`` it is drawn
    from it for each source, so that a rerun agrees and other seeds take other documents; without one it is ``offset``.
    """
    targets = source_targets(sizes, weights, total, most)
    rows = (
        sizes.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.size", "d.source", "t.source_size", "t.target", "d.key")
    )
    drawn = offset if seed is None else drawn_offset(seed, F.col("source"))
    return systematic(rows, drawn).withColumn("taken", F.col("copies") * F.col("size"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("key"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns of any names pass."""
    placed = mix(sizes_of(docs), **settings).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    id_, key, copies, rows, row, copy = (unused(docs, n) for n in ("of_id", "of_key", "of_copies", "of_rows", "of_row", "of_copy"))
    p = placed.where("copies > 0").select(*[F.col(a).alias(b) for a, b in (("doc_id", id_), ("key", key), ("copies", copies), ("rows", rows))])
    same = docs["doc_id"].eqNullSafe(p[id_]) & (F.xxhash64(docs["text"]) == p[key])
    found = docs.join(p, same)
    # rows that repeat an id and a text share their copies; one that stands alone has them all
    again = F.row_number().over(Window.partitionBy(id_, key).orderBy(key))
    cut = lambda i: F.floor(F.col(copies) * i / F.col(rows))
    alone = found.where(F.col(rows) == 1).withColumn(row, F.col(copies).cast("int"))
    several = found.where(F.col(rows) > 1).withColumn(row, again)
    several = several.withColumn(row, (cut(F.col(row)) - cut(F.col(row) - 1)).cast("int"))
    own = alone.unionByName(several)
    return own.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(row)))).select(*[F.col(f"`{c}`") for c in docs.columns])
