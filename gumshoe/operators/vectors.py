"""What searches over vectors share: which vectors count, and the product of two blocks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def limit_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


SCORES = 1 << 20
"""Scores that a worker holds at a time; the queries of a block are taken in slices of so many scores."""


def slices(rows: int, width: int) -> list[slice]:
    """Slices of ``rows`` whose products with ``width`` vectors have at most ``SCORES`` numbers, or one row each."""
    step = max(1, SCORES // max(1, width))
    return [slice(i, i + step) for i in range(0, rows, step)]


def best_of_block(k: int, floor: float, digits: int | None):
    """Worker side: the best ``k`` history rows for every query of a block pair; all vectors have one size."""

    def multiply(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["asked_id"][:0], "vec_id": right["vec_id"][:0], "score": np.empty(0)})
        right = right.sort_values("vec_id", kind="stable", ignore_index=True)
        q = np.stack(left["l_vector"].to_numpy()).astype("float64")
        h = np.stack(right["r_vector"].to_numpy()).astype("float64")
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        h /= np.linalg.norm(h, axis=1, keepdims=True)
        asked, known = left["asked_id"].to_numpy(), right["vec_id"].to_numpy()
        found = [best(q[part] @ h.T, asked[part], known) for part in slices(len(q), len(h))]
        return pd.concat(found, ignore_index=True)

    def best(scores: np.ndarray, asked: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        if digits is not None:
            scores = np.round(scores, digits)
        wanted = scores > floor
        if k < scores.shape[1]:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            wanted &= scores >= kth[:, None]
        row, col = np.nonzero(wanted)
        hits = pd.DataFrame({"row": row, "col": col, "score": scores[row, col]})
        hits = hits.sort_values(["row", "score", "col"], ascending=[True, False, True], kind="stable")
        hits = hits[hits.groupby("row").cumcount() < k]
        return pd.DataFrame({"query_id": asked[hits["row"]], "vec_id": known[hits["col"]], "score": hits["score"].to_numpy()})

    return multiply
