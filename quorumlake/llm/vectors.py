"""Helpers for the two vector searches: usable rows, distinct vectors, pivots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(vec_id long, v array<double>): rows whose id and vector are not null and whose vector holds neither nulls nor non-finite values.

    With ``nonzero``, vectors of zeros only (empty ones too) are left out as well.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad)
    return out.where(F.exists(v, lambda x: x != 0)) if nonzero else out


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``keep`` least ids, ascending.

    Equal vectors score alike and ties go to the smaller id, so no further copy can
    be among the best ``keep`` of any query. The ranking is cut on the map side.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """A bounded sample: the ``rows`` vectors of the least hash, shorter ones padded with zeros."""
    got = [r.v for r in vectors.select("v").orderBy(F.xxhash64("v", F.lit("sample")), "v").limit(rows).collect()]
    return matrix(got, max(map(len, got), default=0))


def matrix(rows, dims: int) -> np.ndarray:
    if len(rows) and all(len(r) == dims for r in rows):
        return np.array([np.asarray(r, dtype=np.float64) for r in rows])
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best(scores: np.ndarray, ids: list[np.ndarray] | np.ndarray, k: int):
    """Indices of the k best columns of each row by (score desc, id asc)."""
    n = scores.shape[1]
    out = []
    for row in scores:
        if n > 4 * k:
            floor = np.partition(row, n - k)[n - k]
            near = np.flatnonzero(row >= floor)
        else:
            near = np.arange(n)
        out.append(near[np.lexsort((ids[near], -row[near]))][:k])
    return out


def expand(found: DataFrame, queries: DataFrame, k: int, score: Column) -> DataFrame:
    """From (q, list of (score, ids)) per distinct query vector to (query_id, rank, vec_id, score) per query row, own row left out.

    ``found``: (v, hits array<struct<score, vec_id>>) with the best ``k + 1`` rows
    in order. A query's own id is dropped wherever it occurs.
    """
    rows = queries.join(found, "v")
    own = F.filter("hits", lambda h: ~h["vec_id"].eqNullSafe(F.col("vec_id")))
    cut = F.slice(own, 1, k)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(cut).alias("pos", "h")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), score.alias("score"))
