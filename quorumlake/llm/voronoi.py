"""Operator 2: exact top-k inner products by a Voronoi kNN join.

Vectors become integers, floor(scale * x). With every candidate lifted by one
coordinate to a common length M, the largest inner product is the least Euclidean
distance: |q - c|^2 = |q|^2 + M^2 - 2 q.c. Queries and candidates are placed in the
Voronoi cells of pivots, whose number grows with the square root of the table up to a
bound. A bounded sample of real vectors gives each query an upper bound on its k-th
distance. A cell of queries is summed up by the largest of these bounds and by the
ring that it occupies around every pivot; a candidate can matter to the cell only if
it lies within the bound of all its rings and of the hyperplane between the two cells.

Neighbouring cells make a group of bounded size, which gets every candidate that one of
its cells needs, once, with a bit for each cell that needs it. There each cell's queries
are scored exactly against the candidates that bear its bit, and against no others.
Summaries are bounded by the square of the number of pivots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, distinct_vectors, expand, matrix, sample, usable

EXACT = 1 << 53


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))


def _pivots(pool: np.ndarray, number: int) -> np.ndarray:
    """Far-apart members of the sample, from its first row on."""
    chosen = [0]
    away = _distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(number, len(pool)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(pool, pool[chosen[-1] :])[:, 0])
    return pool[chosen]


def _lift(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, longest - (x**2).sum(1)))
    return np.hstack([x, extra[:, None]])


def _dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats while they are exact, else by Python integers."""
    if q.size == 0 or c.size == 0 or float(np.abs(q).max()) * float(np.abs(c).max()) * max(1, q.shape[1]) < EXACT:
        return (q @ c.T).astype(np.int64)
    return (q.astype(object) @ c.astype(object).T).clip(-(1 << 63), (1 << 63) - 1).astype(np.int64)


def _order(centre: np.ndarray) -> list[int]:
    """The pivots as a chain, each followed by the nearest that is left."""
    between = _distances(centre, centre)
    chain, left = [0], set(range(1, len(centre)))
    while left:
        chain.append(min(left, key=lambda j: (between[chain[-1], j], j)))
        left.remove(chain[-1])
    return chain


def _needed(d: np.ndarray, cell: np.ndarray, i: int, lo: np.ndarray, hi: np.ndarray, theta: float, between: np.ndarray) -> np.ndarray:
    """May candidates with pivot distances ``d`` lie within ``theta`` of a query of cell ``i``?"""
    gap = np.maximum(d - hi, lo - d).max(axis=1)  # to the rings that the cell's queries occupy
    apart = np.maximum(between[i, cell], 1e-300)  # to the hyperplane between the cells
    plane = np.where(cell == i, 0.0, (d[:, i] ** 2 - d[np.arange(len(d)), cell] ** 2) / (2 * apart))
    return np.maximum(gap, plane) <= theta


def top_k(rows: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, pivot_sample: int = 2048, block: int = 8192, chunk: int = 16_384, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows.

    ``is_query`` is a Column over ``vec_id``. Ties go to the smaller id; with fewer
    than ``k`` other rows all are returned. Rows with a null id or vector or a null or
    non-finite component take no part; a shorter vector counts as padded with
    zeros. Products beyond a long are clipped to it. Rows that repeat an id are not
    answers to a query of that id. No usable rows give no rows.

    ``pivots``: by default a quarter of the root of the number of distinct vectors,
    16 to 128. Groups hold about ``block`` queries, tasks ``chunk`` candidates. A
    ``stats`` dict is filled with the numbers of vectors, cells and groups, of rows sent to
    groups (``sent``) and of those that single cells need (``needed``), of pairs that these
    make with the cells' queries (``pairs``) and of pairs scored (``scored``), which costs passes.
    """
    spark = rows.sparkSession
    whole = usable(rows, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    base = cut(distinct_vectors(whole, k + 1))
    asked = whole.where(is_query)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = base.agg(F.max(norm).alias("longest"), F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    longest, dims, n = float(top.longest or 0.0), int(top.dims or 0), int(top.n)
    pool = sample(base, pivot_sample)
    if not len(pool):
        pool = np.zeros((1, 0))
    pool = np.hstack([pool, np.zeros((len(pool), dims - pool.shape[1]))])
    lifted = _lift(pool, longest, False)
    centre = _pivots(lifted, pivots or min(128, max(16, int(n**0.5 / 4))))
    shared = spark.sparkContext.broadcast((centre, lifted, longest, dims))  # pivot_sample vectors

    def lifted_batches(batches, query: bool):
        _, _, longest, dims = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                yield part, _lift(matrix([v.values.to_numpy(zero_copy_only=False) for v in part.column(0)], dims), longest, query)

    def queried(batches):
        import pyarrow as pa

        centre, lifted, _, _ = shared.value
        for part, x in lifted_batches(batches, True):
            d = _distances(x, centre)
            near = np.partition(_distances(x, lifted), k, axis=1)[:, k] if len(lifted) > k else np.full(len(x), np.inf)  # k + 1: one of them may be the query itself
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d.argmin(1).astype(np.int32)), pa.array(near), pa.array(list(d), pa.list_(pa.float64()))], ["v", "cell", "theta", "d"])

    queries = cut(asked.select("v").distinct().mapInArrow(queried, "v array<double>, cell int, theta double, d array<double>"))

    # summaries: one row a cell, and one a cell and pivot
    cells = {r.cell: (r.theta, r.n) for r in queries.groupBy("cell").agg(F.max("theta").alias("theta"), F.count("*").alias("n")).collect()}
    lo, hi = np.full((len(centre), len(centre)), np.inf), np.full((len(centre), len(centre)), -np.inf)
    for r in queries.select("cell", F.posexplode("d").alias("pivot", "d")).groupBy("cell", "pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect():
        lo[r.cell, r.pivot], hi[r.cell, r.pivot] = r.lo, r.hi
    slack = 1e-6 * (1.0 + float(np.sqrt(longest)) + max([float(x) for x in hi[np.isfinite(hi)]], default=0.0))
    groups: list[list[int]] = []
    held = block
    for i in _order(centre):
        if i in cells:
            if held + cells[i][1] > block:
                groups.append([])
                held = 0
            groups[-1].append(i)
            held += cells[i][1]
    home = {i: g for g, members in enumerate(groups) for i in members}
    parts = {g: max(1, -(-sum(cells[i][1] for i in members) // block)) for g, members in enumerate(groups)}
    chunks = max(1, -(-n // chunk))
    bounds = spark.sparkContext.broadcast((lo, hi, {i: t + slack for i, (t, _) in cells.items()}, groups, _distances(centre, centre)))

    def sent(batches):
        import pyarrow as pa

        centre = shared.value[0]
        lo, hi, theta, groups, between = bounds.value
        for part, x in lifted_batches(batches, False):
            d = _distances(x, centre)
            cell = d.argmin(1)
            for g, members in enumerate(groups):
                wanted = np.stack([_needed(d, cell, i, lo[i], hi[i], theta[i], between) for i in members], axis=1)
                some = wanted.any(axis=1)
                bits = [b.tobytes() for b in np.packbits(wanted[some], axis=1)]
                part_ = part.filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([*part_.columns, pa.array(np.full(part_.num_rows, g, dtype=np.int32)), pa.array(bits, pa.binary())], ["v", "ids", "to", "cells"])

    def by_group(col: str):
        """A group's number of blocks, from its number."""
        return F.element_at(F.array(*(F.lit(parts[g]) for g in range(len(groups))), F.lit(1)), F.col(col) + 1)

    places = base.select("v", "ids").mapInArrow(sent, "v array<double>, ids array<long>, to int, cells binary")
    if stats is not None:
        needed, pairs, sent_ = 0, 0, 0
        for r in places.groupBy("to", "cells").agg(F.count("*").alias("c")).collect():
            bits = np.unpackbits(np.frombuffer(r.cells, dtype=np.uint8))
            sent_, needed = sent_ + r.c, needed + r.c * int(bits.sum())
            pairs += r.c * sum(cells[i][1] for i, b in zip(groups[r.to], bits, strict=False) if b)
        stats.update(vectors=n, queries=sum(c for _, c in cells.values()), pivots=len(centre), cells=len(cells), groups=len(groups), sent=sent_, needed=needed, pairs=pairs)
    scored = spark.sparkContext.accumulator(0)
    # a group's candidates are cut into chunks and its queries into blocks; every block meets every chunk
    left = places.withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), by_group("to") - 1)))
    group_of = F.element_at(F.array(*(F.lit(home.get(i, 0)) for i in range(len(centre)))), F.col("cell") + 1)
    dealt = queries.select("v", "cell", group_of.alias("to")).withColumn("part", F.pmod(F.xxhash64("v"), by_group("to")).cast("int"))
    right = dealt.select("v", "cell", "to", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def solve(key, q, c):
        import pandas as pd

        dims = shared.value[3]
        if not len(q) or not len(c):
            return pd.DataFrame({"v": pd.Series([], dtype=object), "score": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64")})
        x, y, ids = matrix(list(q["v"]), dims), matrix(list(c["v"]), dims), list(c["ids"])
        members, cell = bounds.value[3][int(key[0])], q["cell"].to_numpy()
        asks = np.unpackbits(np.stack([np.frombuffer(b, dtype=np.uint8) for b in c["cells"]]), axis=1)
        out: tuple[list, list, list] = ([], [], [])
        for column, i in enumerate(members):
            mine, theirs = np.flatnonzero(cell == i), np.flatnonzero(asks[:, column])
            scored.add(len(mine) * len(theirs))
            if not len(theirs):
                continue
            least, own = np.array([ids[j][0] for j in theirs]), y[theirs]
            for at in range(0, len(mine), 512):
                some = mine[at : at + 512]
                scores = _dot(x[some], own)
                for r, near in enumerate(best(scores, least, k + 1)):
                    flat = np.concatenate([ids[j] for j in theirs[near]])
                    value = np.repeat(scores[r][near], [len(ids[j]) for j in theirs[near]])
                    pick = np.lexsort((flat, -value))[: k + 1]
                    out[0].extend([q["v"].iloc[some[r]]] * len(pick))
                    out[1].extend(value[pick])
                    out[2].extend(flat[pick])
        return pd.DataFrame({"v": out[0], "score": out[1], "vec_id": out[2]})

    local = right.groupBy("to", "part", "chunk").cogroup(left.groupBy("to", "part", "chunk")).applyInPandas(solve, "v array<double>, score long, vec_id long")
    if stats is not None:
        local = cut(local)
        stats["scored"] = scored.value
    ranked = local.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id"))), 1, k + 1).alias("hits"))
    return expand(ranked, asked, k, -F.col("h.score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
