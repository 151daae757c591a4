"""Operator 10: approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node splits its sample by the hyperplane
halfway between two of its points, or at random where that fails. Every distinct
vector is then routed to one leaf of each tree and shuffled there. A query searches all
trees through one shared priority queue, always opening the branch with the least
bound, until the leaves it has opened hold a budget of rows. A row that several opened
leaves hold is scored once, exactly in double precision, in the first of their trees.

The budget is not guessed: a bounded number of probe vectors is compared with all
vectors, and the queue order of their true neighbours' leaves tells how many rows must
be opened for the recall that is asked for.

Where a leaf holds more rows than one task should, its rows are dealt to parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored
from .vectors import best, distinct_vectors, expand, matrix, sample, usable


class Tree:
    """Arrays of nodes: normal, offset and two children; a leaf's first child is -1 - its number."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, offsets, children = [], [], []
        self.leaves = 0

        def grow(at: np.ndarray) -> int:
            node = len(normals)
            normals.append(np.zeros(points.shape[1]))
            offsets.append(0.0)
            children.append([0, 0])
            if len(at) <= leaf:
                children[node] = [-1 - self.leaves, -1]
                self.leaves += 1
                return node
            x = points[at]
            for _ in range(4):
                a, b = x[rng.integers(len(x), size=2)]
                normal, offset = a - b, float((a @ a - b @ b) / 2)
                side = x @ normal > offset
                if 0.1 < side.mean() < 0.9:
                    break
            else:
                normal = rng.standard_normal(x.shape[1])
                along = x @ normal
                offset = float(np.median(along))
                side = along > offset
                if side.all() or not side.any():
                    children[node] = [-1 - self.leaves, -1]
                    self.leaves += 1
                    return node
            norm = float(np.linalg.norm(normal)) or 1.0
            normals[node], offsets[node] = normal / norm, offset / norm
            children[node] = [grow(at[side]), grow(at[~side])]
            return node

        grow(np.arange(len(points)))
        self.normal, self.offset, self.child = np.array(normals), np.array(offsets), np.array(children)

    def route(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        open_ = np.flatnonzero(self.child[node, 0] >= 0)
        while len(open_):
            at = node[open_]
            side = np.einsum("ij,ij->i", x[open_], self.normal[at]) > self.offset[at]
            node[open_] = self.child[at, np.where(side, 0, 1)]
            open_ = open_[self.child[node[open_], 0] >= 0]
        return -1 - self.child[node, 0]


class Forest:
    """The trees' nodes in one array, with leaves numbered through all trees."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        sizes = [len(t.child) for t in trees]
        self.roots = np.cumsum([0, *sizes])[:-1]
        self.first = np.cumsum([0, *(t.leaves for t in trees)])  # a tree's first leaf
        self.normal, self.offset = np.concatenate([t.normal for t in trees]), np.concatenate([t.offset for t in trees])
        self.levels, self.leaf_node = [], np.zeros(self.first[-1], dtype=np.int64)
        child = np.concatenate([np.where(t.child[:, :1] < 0, t.child, t.child + r) for t, r in zip(trees, self.roots, strict=True)])
        for t, r, f in zip(trees, self.roots, self.first, strict=False):
            ends = np.flatnonzero(t.child[:, 0] < 0)
            self.leaf_node[f - 1 - t.child[ends, 0]] = ends + r
        at = self.roots
        while len(at := at[child[at, 0] >= 0]):
            self.levels.append((at, child[at, 0], child[at, 1]))
            at = child[at].ravel()

    def route(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf in every tree."""
        return np.stack([t.route(x) + f for t, f in zip(self.trees, self.first, strict=False)], axis=1).astype(np.int32)

    def order(self, q: np.ndarray) -> np.ndarray:
        """For each row of ``q``, all leaves in the order in which one priority queue over all trees gives them up.

        A branch's priority is the largest distance by which the query lies on the wrong
        side of a hyperplane above it. That never falls along a path, so the queue opens
        leaves by their own priorities; ties go to the smaller number.
        """
        wrong = q @ self.normal.T - self.offset
        bound = np.full(wrong.shape, -np.inf)
        for at, yes, no in self.levels:
            bound[:, yes] = np.maximum(bound[:, at], -wrong[:, at])
            bound[:, no] = np.maximum(bound[:, at], wrong[:, at])
        return np.argsort(bound[:, self.leaf_node], axis=1, kind="stable")


def opened(forest: Forest, counts: np.ndarray, q: np.ndarray, budget: int) -> np.ndarray:
    """Which leaves (columns) each query (row) opens until they hold ``budget`` rows."""
    order = forest.order(q)
    held = np.cumsum(counts[order], axis=1)
    out = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(out, order, held - counts[order] < budget, axis=1)
    return out


def _budget(forest: Forest, counts: np.ndarray, probes: np.ndarray, truth: list[np.ndarray], recall: float) -> int:
    """Rows to open so that ``recall`` of the probes' true neighbours (their leaves in ``truth``) are reached."""
    need: list[int] = []
    for at in range(0, len(probes), 16):
        order = forest.order(probes[at : at + 16])
        held = np.cumsum(counts[order], axis=1)
        reached = np.empty_like(held)
        np.put_along_axis(reached, order, held, axis=1)
        for r, leaves in enumerate(truth[at : at + 16]):
            need += reached[r][leaves].min(axis=1).tolist()
    if not need:
        return int(counts.sum())
    return int(np.sort(need)[min(len(need), int(np.ceil(recall * len(need)))) - 1])


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 12, leaf: int = 32, sample_rows: int = 20_000, recall: float = 0.93, probes: int = 128, part: int = 32_768, seed: int = 7, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest found, by inner product.

    ``is_query`` is a Column over ``vec_id``. The forest is grown on at most
    ``sample_rows`` vectors, with leaves of about ``leaf`` rows of the whole table
    where the sample allows that (8 sampled rows at least); every usable vector is
    indexed in every tree. The budget of rows that a query opens is what ``recall`` asks
    for on ``probes`` sampled vectors, compared with all vectors; it follows data and
    size. Ties go to the smaller id; a query's own id is never returned. Null ids, null
    and zero vectors and those with null or non-finite components take no part; a
    shorter vector counts as padded with zeros. Rows that repeat an id are not answers
    to a query of that id. No usable rows give no rows.

    A ``stats`` dict is filled with the numbers of distinct vectors, of leaves and of
    rows to open (``budget``, over all trees).
    """
    spark = rows.sparkSession
    whole = usable(rows, id_col, vec_col, nonzero=True)
    base = cut(distinct_vectors(whole, k + 1))
    asked = whole.where(is_query)
    top = base.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    dims, n = int(top.dims or 0), int(top.n)
    pool = sample(base, sample_rows)
    pool = np.hstack([pool, np.zeros((len(pool), dims - pool.shape[1]))]) if len(pool) else np.zeros((0, dims))
    size = max(8, leaf * len(pool) // max(1, n))
    forest = Forest([Tree(pool, size, np.random.default_rng((seed, i))) for i in range(trees)])
    shared = spark.sparkContext.broadcast((forest, pool[:probes], dims))  # bounded by the sample

    def vectors(batch, dims: int) -> np.ndarray:
        return matrix([v.values.to_numpy(zero_copy_only=False) for v in batch.column(0)], dims)

    def routed(batches):
        import pyarrow as pa

        forest, _, dims = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(forest.route(vectors(some, dims))), pa.list_(pa.int32()))], ["v", "ids", "leaves"])

    indexed = stored(base.select("v", "ids").mapInArrow(routed, "v array<double>, ids array<long>, leaves array<int>"))
    counts = np.zeros(forest.first[-1], dtype=np.int64)
    for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row a leaf
        counts[r.leaf] = r.n

    def probed(batches):
        """The nearest ``k + 1`` rows of the task to every probe."""
        import pyarrow as pa

        _, probes, dims = shared.value
        best_, leaves = np.full((len(probes), 0), -np.inf), np.zeros((len(probes), 0, trees), dtype=np.int32)
        for b in batches:
            s = probes @ vectors(b, dims).T
            own = np.array(b.column(2).to_pylist(), dtype=np.int32).reshape(-1, trees)
            s, own = np.hstack([best_, s]), np.concatenate([leaves, np.broadcast_to(own, (len(probes), *own.shape))], axis=1)
            keep = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            best_, leaves = np.take_along_axis(s, keep, axis=1), np.take_along_axis(own, keep[:, :, None], axis=1)
        r, c = np.nonzero(np.isfinite(best_))
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(best_[r, c]), pa.array(list(leaves[r, c]), pa.list_(pa.int32()))], ["probe", "score", "leaves"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "leaves")
    near = indexed.mapInArrow(probed, "probe int, score double, leaves array<int>").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    truth: dict[int, list] = {}
    for r in near.where("rn > 1").collect():  # k rows a probe; the first is the probe itself, as good as always
        truth.setdefault(r.probe, []).append(r.leaves)
    known = [i for i in range(min(probes, len(pool))) if i in truth]
    budget = _budget(forest, counts, pool[known], [np.array(truth[i]) for i in known], recall)
    if stats is not None:
        stats.update(vectors=n, leaves=len(counts), budget=budget)

    # neighbouring leaves of a tree share a task of about `part` rows; a larger leaf is dealt to several
    task = np.concatenate([(np.cumsum(c) - c) // part for c in np.split(counts, forest.first[1:-1])]) if len(counts) else counts
    split = np.maximum(1, -(-counts // part))
    tree_of = np.repeat(np.arange(trees), np.diff(forest.first))
    known_places = spark.sparkContext.broadcast((counts, task, split, tree_of))

    def placed(batches):
        import pyarrow as pa

        _, task, split, _ = known_places.value
        for b in batches:
            leaves = np.array(b.column(2).to_pylist(), dtype=np.int32).reshape(-1, trees)
            first = np.array([i[0] for i in b.column(1).to_pylist()], dtype=np.int64)
            for i in range(trees):
                at = leaves[:, i]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(task[at]), pa.array((first * 0x9E3779B1 >> 16) % split[at])], ["v", "ids", "leaves", "tree", "task", "deal"])

    def walked(batches):
        import pyarrow as pa

        forest, _, dims = shared.value
        counts, task, split, tree_of = known_places.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                open_ = opened(forest, counts, vectors(some, dims), budget) & (counts > 0)
                out: tuple[list, ...] = ([], [], [], [], [])
                for r in range(some.num_rows):
                    for i in range(trees):
                        a, z = forest.first[i], forest.first[i + 1]
                        mine = np.flatnonzero(open_[r, a:z]) + a
                        bits = np.packbits(open_[r, :z]).tobytes()
                        for t in np.unique(task[mine]):
                            for deal in range(int(split[mine[task[mine] == t]].max())):
                                for col, y in zip(out, (r, i, int(t), deal, bits), strict=True):
                                    col.append(y)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(out[0], pa.int32())), *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], ["v", "tree", "task", "deal", "opened"])

    spread = indexed.mapInArrow(placed, "v array<double>, ids array<long>, leaves array<int>, tree int, task long, deal long")
    visits = asked.select("v").distinct().repartition(spark.sparkContext.defaultParallelism).mapInArrow(walked, "v array<double>, tree int, task long, deal long, opened binary")

    def solve(key, q, c):
        import pandas as pd

        dims, tree = shared.value[2], int(key[0])
        out: tuple[list, list] = ([], [])
        if len(q) and len(c):
            y = matrix(list(c["v"]), dims)
            flat = [np.asarray(i) for i in c["ids"]]
            firsts = np.array([i[0] for i in flat])
            leaves = np.ascontiguousarray(np.stack(list(c["leaves"]))[:, : tree + 1].T)
            for v, bits in zip(q["v"], q["opened"], strict=True):
                open_ = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
                at = np.flatnonzero(open_[leaves[tree]])
                for other in leaves[:tree]:  # scored in an earlier tree
                    at = at[~open_[other[at]]]
                if not len(at):
                    continue
                scores = (y[at] * matrix([v], dims)).sum(axis=1)  # the same sum in every task
                (near,) = best(scores[None], firsts[at], k + 1)
                hits = sorted((-scores[j], int(i)) for j in near for i in flat[at[j]])[: k + 1]
                out[0].append(v)
                out[1].append([{"score": s, "vec_id": i} for s, i in hits])
        return pd.DataFrame({"v": pd.Series(out[0], dtype=object), "hits": pd.Series(out[1], dtype=object)})

    hits = "array<struct<score: double, vec_id: long>>"
    local = visits.groupBy("tree", "task", "deal").cogroup(spread.groupBy("tree", "task", "deal")).applyInPandas(solve, f"v array<double>, hits {hits}")
    # at most k + 1 hits of each task a query has visited
    merged = local.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    return expand(merged, asked, k, -F.col("h.score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
