"""Near copies by SimHash, each link confirmed on the word shingles' sets, and an exact way for the rest.

First every node gets the SimHash of its five-word shingles; pigeonring finds what lies
within 3 bits (``simhash.links``), and each node is compared with the least node of its
component. A Jaccard similarity of 0.8 is about 10 of 64 bits, with a deviation of 3, so
SimHash alone would lose links. What it leaves apart is joined by prefixes.

A set's prefix is its rarest n - ceil(s n) + 1 shingles in one order that all sets
share: two sets of similarity s or more have a prefix shingle in common, so the join
on prefix shingles loses no pair. The order puts shingles that are frequent
in a sample last; the sample decides how many candidates there are, never the result.

Equal texts are one node. Each prefix shingle has a head among its nodes. In two turns,
with other heads each, a node is compared with the head it shares most prefix shingles
with, unless SimHash has linked the two. First heads are those with most of their set left
from the shingle on: the texts that large groups have drifted from. Then nodes that are still in separate components are compared if what follows
their first common prefix shingle can hold enough: a shingle at place i of n and at j of
m allows min(n - i, m - j) in common, itself included. A pair's texts are read only if its
prefixes have enough in common: the prefix that ends first in the order holds all it
shares with the other set up to there, so c common prefix shingles allow
c + ceil(s n) - 1 in all, n being the larger size. Shingles are known by their XXH64;
every link is confirmed on the whole sets. Components follow by star contraction.

Only prefix shingles and the texts of compared nodes are shuffled; rows are read again
at the end and lose what a list names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, dense, discard, release, sliced, stored

SAMPLE, SHARE, FREQUENT = 4096, 12, 1_000_000  # texts looked at, or that share of all if it is more, and shingles kept, for the order
STEP = 256  # texts whose shingles make one batch
LISTED = 1_000_000  # entries of a list up to which it is broadcast (about 100 MB); longer ones are joined


def shingles(text: bytes, words: int = 5):
    """The sorted XXH64 (seed 42) of the distinct word shingles; shorter texts are one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # as simhash.fingerprint
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in parts), dtype=np.uint64))


def _listed(df: DataFrame) -> DataFrame:
    """``df``, which has been cut, for a join: broadcast if it is short."""
    return F.broadcast(df) if df.count() <= LISTED else df


def _once(texts: DataFrame) -> DataFrame:
    """``texts`` (node, text) less most copies: a task keeps a node's first."""

    def task(batches):
        import pyarrow as pa

        release()
        seen: set[int] = set()
        for batch in sliced(batches):
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(task, texts.schema)


def _frequent(texts: DataFrame, words: int, rows: int):
    """(hash, count) arrays, sorted by hash, of shingles that several texts of a sample have."""
    import numpy as np

    def task(batches):
        import pyarrow as pa

        release()
        for batch in sliced(batches, STEP):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py(), words) for t in batch.column(0)]).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(max(1, min(SHARE, rows // SAMPLE)))) == 0).dropDuplicates(["node"])
    counts = some.select("text").mapInArrow(task, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()  # bounded: FREQUENT pairs of numbers
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy()[order]


def _prefixes(texts: DataFrame, words: int, similarity: tuple[int, int], frequent) -> DataFrame:
    """(key, node, n, i): the prefix shingles of every node, the size of its set and the place in it."""
    shared, (num, den) = texts.sparkSession.sparkContext.broadcast(frequent), similarity

    def task(batches):
        import numpy as np
        import pyarrow as pa

        release()
        known, counts = shared.value

        def prefix(text):
            h = shingles(text, words)
            at = np.searchsorted(known, h)
            rank = np.zeros(len(h), dtype=np.int64)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == h[hit]
            rank[hit] = counts[at[hit]]
            return h[np.lexsort((h, rank))[: len(h) - -(-num * len(h) // den) + 1]].view(np.int64), len(h)

        for batch in sliced(batches, STEP):
            if not batch.num_rows:
                continue
            keys, sizes = zip(*(prefix(t.as_py()) for t in batch.column(1)), strict=True)
            times = list(map(len, keys))
            places = np.concatenate([np.arange(x) for x in times])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), times)), pa.array(np.repeat(sizes, times).astype(np.int32)), pa.array(places.astype(np.int32))], ["key", "node", "n", "i"])

    return texts.mapInArrow(task, "key long, node long, n int, i int")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int], rows: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough; ``rows``: about how many texts there are."""
    num, den = similarity

    def task(batches):
        import numpy as np
        import pyarrow as pa

        release()
        known = lru_cache(maxsize=64)(lambda t: shingles(t, words))
        for batch in sliced(batches, STEP):
            same = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = known(s), known(t)
                same.append((num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    nodes = cut(dense(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows))
    held = _once(texts.join(_listed(nodes), "node", "left_semi")).groupBy("node").agg(F.first("text").alias("text"))
    left, right = (held.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def simhash_pairs(texts: DataFrame, words: int, rows: int | None = None) -> DataFrame:
    """(a, b), a < b: every node of ``texts`` (about ``rows``) with the least node of its SimHash component, unless it is that."""

    def task(batches):
        import pyarrow as pa

        release()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash.fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["node", "fp"])

    rows = texts.count() if rows is None else rows
    prints = cut(dense(_once(texts).mapInArrow(task, "node long, fp long").groupBy("node").agg(F.first("fp").alias("fp")), rows))  # rows of one node have one text
    reach = components(simhash.links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = cut(dense(prints.join(reach, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), rows))
    least = rooted.groupBy("root").agg(F.min("node").alias("least"))
    return rooted.join(least, "root").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))


def _enough(most: Column, both: Column, similarity: tuple[int, int]) -> Column:
    """Can sets with ``common`` prefix shingles in common be similar enough? ``most``: the larger size, ``both``: the sizes' sum."""
    num, den = similarity
    return (F.col("common") + F.ceil(most * num / den) - 1) * (num + den) >= both * num


def _plausible(pairs: DataFrame, members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The distinct ``pairs`` (a, b, n, m) whose prefixes have enough in common, with a < b."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("n", "m").alias("most"), (F.col("n") + F.col("m")).alias("both")).distinct()
    mine, theirs = (members.select("key", F.col("node").alias(k)) for k in "ab")
    counted = pairs.join(mine, "a").join(theirs, ["b", "key"]).groupBy("a", "b", "most", "both").agg(F.count("*").alias("common"))
    return counted.where(_enough(F.col("most"), F.col("both"), similarity)).select("a", "b")


def _spacious(live: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The rows (key, node, n, i, root) of ``live`` that can be a similar pair's first common shingle, by what their key's other rows allow.

    Of a pair (n, i), (m, j) both n - i and m - j hold all that is common: n den - i (num + den)
    is num m at least, and m den - j (num + den) num n. Here m and j may come from two rows, so no pair is lost.
    """
    num, den = similarity
    over, n = Window.partitionBy("key"), F.col("n").cast("long")
    room = live.select("key", "node", "n", "i", "root", (n * den - F.col("i") * (num + den)).alias("room"))
    room = room.select("*", F.min("n").over(over).alias("least"), F.max("room").over(over).alias("most"))
    room = room.where((F.col("room") >= F.col("least") * num) & (F.col("room") * den >= n * num * num) & (F.col("most") >= n * num))
    both = room.select("*", F.min("root").over(over).alias("lo"), F.max("root").over(over).alias("hi"))
    return both.where("lo < hi").select("key", "node", "n", "i", "root")


def _roomy(live: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b), a < b, of ``live`` (key, node, n, i, root) in separate components that places and common prefix shingles allow.

    Pairs come from rows with room enough, and common shingles are counted for them alone:
    texts of a large group that have drifted too far from it to be similar make no rows.
    """
    num, den = similarity
    some = _spacious(live, similarity)
    mine = some.select("key", F.col("node").alias("a"), "n", "i", "root")
    theirs = some.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    n, m, i, j = map(F.col, "nmij")
    alike = F.least(n, m) * den >= F.greatest(n, m) * num
    fits = F.least(n - i, m - j) * (num + den) >= (n + m) * num
    pairs = mine.join(theirs, "key").where("root < other").where(alike & fits).select("a", "b", "n", "m")
    return _plausible(pairs, live, similarity)


def _head(turn: int, *columns: str) -> Column:
    """The key's node with ``columns``: at first the one with the most of its set left from the key on, later that of the least hash.

    What a group's texts have in common is all of the first's; one that is close to any two of them is close to it.
    """
    place = F.col("i") / F.col("n") if turn == 0 else F.lit(0.0)
    return F.min(F.struct(place.alias("place"), F.xxhash64("node", F.lit(turn)).alias("by"), F.col("node").alias("b"), F.col("n").alias("m"), *columns))


def links(texts: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5), rows: int | None = None) -> DataFrame:
    """(a, b): links that connect the nodes of ``texts`` (node, text as binary) as all similar pairs do, those of SimHash first.

    Rows of one node have one text. ``rows``: about how many texts there are.
    """
    num, den = similarity
    alike = F.least("n", "m") * den >= F.greatest("n", "m") * num
    rows = texts.count() if rows is None else rows
    keyed = _prefixes(_once(texts), words, similarity, _frequent(texts, words, rows)).repartition("key")
    alone = Window.partitionBy("key")
    headed = keyed.select("*", F.min("node").over(alone).alias("lo"), F.max("node").over(alone).alias("hi"), _head(0).over(alone).alias("head")).where("lo < hi")
    members = stored(headed.dropDuplicates(["key", "node"]).select("key", "node", "n", "i", "head.b", "head.m"))
    tried = cut(dense(simhash_pairs(texts, words, rows), rows))
    found = cut(_confirmed(tried, texts, words, similarity, rows))
    live = members
    for turn in range(3):
        roots = cut(dense(components(found), rows))
        if turn == 0:
            pairs = live.where("node <> b").select(F.col("node").alias("a"), "b", "n", "m")
        else:
            rooted = members.select("key", "node", "n", "i").join(_listed(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
            open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), _head(turn, "root").alias("head")).where("lo < hi")
            live = cut(rooted.join(open_, "key").select("key", "node", "n", "i", "root", F.col("head.b").alias("b"), F.col("head.m").alias("m"), F.col("head.root").alias("other")))
            pairs = live.where("root <> other").select(F.col("node").alias("a"), "b", "n", "m")
        if turn < 2:  # the head a node shares most shingles with
            best = pairs.where(alike).groupBy("a", "b", "n", "m").agg(F.count("*").alias("c")).groupBy("a").agg(F.max(F.struct("c", "b", "n", "m")).alias("best"))
            pairs = best.select("a", "best.b", "best.n", "best.m")
            if turn == 0:  # later turns have left out what is linked
                for k in "ab":
                    pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
                pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "n", "m")
            pairs = _plausible(pairs, live, similarity)
        else:
            pairs = _roomy(live, similarity)
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        found = cut(found.union(_confirmed(pairs, texts, words, similarity, rows)))
        tried = tried.union(pairs)
    discard(members)
    return found


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near copies: that of the least id.

    Texts are linked whose sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` (a fraction) or more; a group is what links reach. Texts without a
    word (null and empty ones among them) are one group. A null id is least only in a
    group without others; of rows alike in id and text one stays. Texts are the same if
    their SHA-256 is; a text whose 64-bit node another text has too is no near copy of any.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"_digest": F.unhex(F.sha2(text.cast("binary"), 256)), "_doc": F.col(id_col).cast("long")}
    ids = cut(docs.select(*(c.alias(k) for k, c in keys.items()), F.xxhash64(text).alias("node")).groupBy("_digest", "_doc", "node").agg(F.count("*").alias("times")))
    first = F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("doc"), "_digest")
    least = cut(ids.groupBy("node").agg(F.min(first).alias("least"), F.min("_digest").alias("lo"), F.max("_digest").alias("hi")))
    texts = docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))
    linked = cut(components(links(texts, words, similarity, least.count())))
    linked = linked.join(least.where("lo = hi"), "node").select("node", "root", "least")  # a shared node stays apart
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    groups = linked.join(heads, "root").select("node", "head")
    own = ids.join(least.where("lo < hi").select("node").withColumn("shared", F.lit(True)), "node", "left").join(groups, "node", "left")
    own = own.join(ids.groupBy("_digest").agg(F.min(first).alias("least")), "_digest")
    stays = first.eqNullSafe(F.when(F.col("shared"), F.col("least")).otherwise(F.coalesce("head", "least")))
    # rows that go, and those that stay but are repeated
    other = cut(own.withColumn("stays", stays).where(~F.col("stays") | (F.col("times") > 1)).select(*keys, "stays"))
    rows = docs.select(F.struct("*").alias("_row"), *(c.alias(k) for k, c in keys.items()))
    same = lambda listed: (rows["_digest"] == listed["_digest"]) & rows["_doc"].eqNullSafe(listed["_doc"])
    repeated = cut(other.where("stays").drop("stays"))
    gone = _listed(other)
    single = rows.join(gone, same(gone), "left_anti").select("_row.*")
    again = _listed(repeated)
    turn = F.row_number().over(Window.partitionBy("_digest", "_doc").orderBy(F.xxhash64(F.to_json("_row"))))
    return single.unionByName(rows.join(again, same(again), "left_semi").withColumn("_rn", turn).where("_rn = 1").select("_row.*"))
