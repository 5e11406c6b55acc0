"""Exact quartiles of many columns at any size, in two reads.

``percentile`` keeps a column's distinct values in one task, which fails on a large table. Here a mergeable KLL sketch per column, made
in one read or merged from sketches of earlier batches, gives brackets that hold the quartiles and the fences; a second read counts the
values beside the brackets as a whole and those inside one by one. Values inside are binned, so that an order statistic is found by
running counts over at most a few million bins and then over the values of one bin.

A sketch's rank error is random with a known spread; the brackets are several times as wide. A bracket that misses its quartile
nevertheless ends the job with a message, never in a wrong number.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions.text import quoted

FINE_BINS = 1 << 20
SKETCH_K = 8192
"""Size of a sketch; about 5 in 1000 values lie in the brackets of the quartiles."""
RANKS = ["r0", "r1", "r2", "r3"]  # ranks around the first and the third quartile
REACH = 3  # interquartile ranges to a fence
BRACKETS = 4
_SHARES = (0.25, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, x)`` for every present number of the chosen columns."""
    columns = numeric_columns(df) if columns is None else columns
    values = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([], [quoted(c) for c in columns], "column_name", "x")
    return long.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def sketch_of(x: Column, k: int = SKETCH_K) -> Column:
    """An aggregate: the mergeable sketch of a column's present numbers."""
    x = x.cast("double")
    return F.kll_sketch_agg_double(F.when(x.isNotNull() & ~F.isnan(x), x + 0.0), F.lit(k))


def sketches(long: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """``(column_name, sketch)`` of ``long (column_name, x)``."""
    return long.groupBy("column_name").agg(sketch_of(F.col("x"), k).alias("sketch"))


def merged(several: DataFrame) -> DataFrame:
    """One sketch per column from the sketches of many batches."""
    return several.filter(F.kll_sketch_get_n_double("sketch") > 0).groupBy("column_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch")
    )


def _margin(k: int) -> float:
    """Half a bracket's width in ranks: several times the error of a sketch of size ``k`` at 99 % confidence."""
    return 4 * 2.296 / k**0.9021


def _marks(known: DataFrame, k: int) -> DataFrame:
    """One row per column: its ranks, and the brackets as ascending ends ``h0..`` with the place ``l0..`` from which values count singly."""
    known = known.withColumn("total", F.kll_sketch_get_n_double("sketch")).filter(F.col("total") > 0)
    last = F.col("total") - 1
    low, high = F.floor(last * _SHARES[0]), F.floor(last * _SHARES[1])
    ranks = [low.alias("r0"), F.least(low + 1, last).alias("r1"), high.alias("r2"), F.least(high + 1, last).alias("r3")]
    wide = F.col("total") * _margin(k) >= 2  # else the few values are all counted one by one

    def at(share: float, side: int) -> Column:
        least = F.kll_sketch_get_quantile_double("sketch", F.lit(float(max(side, 0))))
        return F.when(wide, F.kll_sketch_get_quantile_double("sketch", F.lit(share + side * _margin(k)))).otherwise(least)

    found = [at(s, side).alias(n) for n, (s, side) in zip("abcd", ((s, side) for s in _SHARES for side in (-1, 1)), strict=True)]
    known = known.select("column_name", "total", *ranks, *found)
    # fences lie between those of the narrowest and of the widest interquartile range; the slack covers rounding
    a, b, c, d = map(F.col, "abcd")
    slack = (F.abs(a) + F.abs(d)) * 1e-9
    bracket = lambda low, high: F.struct(F.nanvl(high, F.lit(math.inf)).alias("h"), F.nanvl(low, F.lit(-math.inf)).alias("l"))
    ends = [
        bracket(a - REACH * (d - a) - slack, b - REACH * (c - b) + slack),
        bracket(a, b),
        bracket(c, d),
        bracket(c + REACH * (c - b) - slack, d + REACH * (d - a) + slack),
    ]
    known = known.select("column_name", "total", *RANKS, F.sort_array(F.array(*ends)).alias("ends"))
    out = []
    for i in range(BRACKETS):
        high = F.col("ends")[i]["h"]
        least = F.array_min(F.slice(F.col("ends")["l"], i + 1, BRACKETS))
        out += [high.alias(f"h{i}"), (F.greatest(least, F.col("ends")[i - 1]["h"]) if i else least).alias(f"l{i}")]
    return known.select("column_name", "total", *RANKS, *out)


def _counted(long: DataFrame, marks: DataFrame) -> DataFrame:
    """The second read: ``(column_name, zone, single, bin, value)`` with n, lo and hi; one row per column is broadcast."""
    x, zones = F.col("x"), range(BRACKETS)
    zone = reduce(lambda a, b: a + b, [(F.col(f"h{i}") < x).cast("int") for i in zones])
    at = lambda name: reduce(lambda rest, i: F.when(F.col("zone") == i, F.col(f"{name}{i}")).otherwise(rest), zones, F.lit(None).cast("double"))
    rows = long.join(F.broadcast(marks.drop("total", *RANKS)), "column_name").withColumn("zone", zone)
    low, high = at("l"), at("h")
    # the zone above its predecessor's end holds first the values counted as a whole, then those of its bracket
    rows = rows.select("column_name", "x", "zone", F.coalesce(x >= low, F.lit(False)).alias("single"), low.alias("low"), high.alias("high"))
    share = (x - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    fine = F.when(x >= F.col("high"), FINE_BINS - 1).when(F.isnan(share), 0).otherwise(F.floor(share * FINE_BINS))
    bin_ = F.when(F.col("single"), F.least(F.greatest(F.coalesce(fine, F.lit(0)), F.lit(0)), F.lit(FINE_BINS - 1)))
    return rows.groupBy("column_name", "zone", "single", bin_.cast("int").alias("bin"), F.when(F.col("single"), x).alias("value")).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )


def _holding(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in which a wanted rank lies, with the ranks counted inside the row."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(*order)) - F.col("n")
    counts = counts.withColumn("before", before)
    inside = [
        F.when((F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("n")), F.col(r) - F.col("before")).alias(r)
        for r in RANKS
    ]
    kept = counts.select(*[c for c in counts.columns if c not in ("before", *RANKS)], *inside)
    return kept.filter(reduce(lambda a, b: a | b, [F.col(r).isNotNull() for r in RANKS]))


def _found(counted: DataFrame, marks: DataFrame) -> DataFrame:
    """``(column_name, n, q1, q3)`` by linear interpolation between neighbours."""
    place = ["zone", "single", "bin"]
    bins = counted.groupBy("column_name", *place).agg(F.sum("n").alias("n"))
    bins = bins.join(F.broadcast(marks.select("column_name", "total", *RANKS)), "column_name")
    bins = _holding(bins, ["column_name"], place).drop("n")  # at most four rows per column
    bins = bins.select("column_name", "total", *RANKS, *[F.col(p).alias(f"at_{p}") for p in place])
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"at_{p}")) for p in place])
    values = counted.join(F.broadcast(bins.withColumnRenamed("column_name", "of")), (F.col("column_name") == F.col("of")) & same)
    values = _holding(values, ["column_name", *place], ["value"])
    missed = F.max((~F.col("single")).cast("int")) == 1
    found = values.groupBy("column_name", "total").agg(
        missed.alias("missed"), *[F.max(F.when(F.col(r).isNotNull(), F.col("value"))).alias(r) for r in RANKS]
    )

    def between(a: str, b: str, p: float) -> Column:
        place = (F.col("total") - 1) * p
        step = place - F.floor(place)
        exact = F.when(step == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * step)
        return F.when(F.col("missed"), F.raise_error(F.lit("a sketch missed its quartile: use a larger one")).cast("double")).otherwise(exact)

    return found.select(
        "column_name",
        F.col("total").alias("n"),
        between("r0", "r1", _SHARES[0]).alias("q1"),
        between("r2", "r3", _SHARES[1]).alias("q3"),
    )


def quartiles(long: DataFrame, accuracy: int | None = None, known: DataFrame | None = None, k: int = SKETCH_K) -> DataFrame:
    """``(column_name, n, q1, q3)`` of ``long (column_name, x)``, exact, or with ``accuracy`` approximate and in one read.

    ``known`` are the sketches (of size ``k``) of exactly these values, as :func:`sketches` or :func:`merged` give them.
    """
    if accuracy is not None:
        q = F.percentile_approx("x", list(_SHARES), accuracy)
        return long.groupBy("column_name").agg(F.count("*").alias("n"), q.alias("q")).select(
            "column_name", "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")
        )
    marks = _marks(sketches(long, k) if known is None else known, k)
    return _found(_counted(long, marks), marks)


def outliers(long: DataFrame, accuracy: int | None = None, known: DataFrame | None = None, k: int = SKETCH_K) -> DataFrame:
    """``(column_name, n_outliers, lower, upper)`` of columns with values beyond the fences; the exact ones in the same two reads."""
    if accuracy is not None:
        counted = long.select("column_name", F.lit(1).alias("n"), F.col("x").alias("lo"), F.col("x").alias("hi"))
        bounds = fences(quartiles(long, accuracy))
    else:
        marks = _marks(sketches(long, k) if known is None else known, k)
        counted = _counted(long, marks)
        bounds = fences(_found(counted, marks))
    far = counted.join(F.broadcast(bounds), "column_name").filter(  # one row per numeric column
        (F.col("hi") < F.col("lower")) | (F.col("lo") > F.col("upper"))
    )
    return far.groupBy("column_name").agg(
        F.sum("n").alias("n_outliers"), F.first("lower").alias("lower"), F.first("upper").alias("upper")
    )


def fences(quarts: DataFrame) -> DataFrame:
    """``(column_name, lower, upper)`` three interquartile ranges out; flat columns have none."""
    iqr = F.col("q3") - F.col("q1")
    return quarts.filter(iqr > 0).select(
        "column_name", (F.col("q1") - REACH * iqr).alias("lower"), (F.col("q3") + REACH * iqr).alias("upper")
    )
