"""Operator 3: near-duplicate groups by SimHash with pigeonring filtering.

Two fingerprints within ``TAU`` = 3 bits, cut into 8 segments on a ring, have a
segment from which every chain of 1, 2, ... 8 consecutive segments differs in at
most 3/8 bits a segment: 0, 0, 1, 1, 1, 2, 2, 3 bits. The first five quotas become
join keys: the chain's two first segments are equal, and so are two of its next
three. That is 24 keys of 32 exact bits a fingerprint. Longer chains are checked
on each candidate before the full Hamming distance.

Equal fingerprints are one node, so copies are never paired. A key's fingerprints are cut
into blocks, and every two blocks are compared in one task: pairs within their key's
chain quotas go to the full check, and a spanning link is returned for each fingerprint,
not all pairs. Keys that hold more than a thousandth of all fingerprints, of which there
are at most 24,000, are known to every task, so their rows are dealt out before the
shuffle. Components follow by star contraction.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut

SEGMENTS, WIDTH, TAU = 8, 8, 3
QUOTAS = [length * TAU // SEGMENTS for length in range(1, SEGMENTS + 1)]
BLOCK = 2048


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of the word shingles' XXH64 (seed 42); 0 without words."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()  # on bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(task, "doc_id long, fp long")


def _turned(x: Column, start: int) -> Column:
    return x if start == 0 else F.shiftleft(x, WIDTH * start).bitwiseOR(F.shiftrightunsigned(x, 64 - WIDTH * start))


def ring_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: start segment, the segment left open, the other four of five."""
    keys = []
    for start in range(SEGMENTS):
        chain = F.shiftrightunsigned(_turned(fp, start), 64 - 5 * WIDTH)
        for open_ in (2, 3, 4):
            mask = (1 << 5 * WIDTH) - 1 - (255 << WIDTH * (4 - open_))
            keys.append(chain.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((start * 5 + open_) << 5 * WIDTH)))
    return F.array(*keys)


def _linked(bits: np.ndarray, start: int) -> np.ndarray:
    """Which of the differences ``bits`` stay within every chain's quota from the segment ``start`` on, the whole ring's being ``TAU``?

    The first five chains are so by the key; longer ones are looked at for what the shorter leave.
    """
    turn = np.uint64(WIDTH * start)
    ring = bits if start == 0 else (bits << turn) | (bits >> (np.uint64(64) - turn))
    ok = np.ones(bits.shape, dtype=bool)
    for length in (5, 6, 7, 8):
        ok[ok] = np.bitwise_count(ring[ok] >> np.uint64(64 - WIDTH * length)) <= QUOTAS[length - 1]
    return ok


def _block_links(rows):
    """Spanning links among the fingerprints of two blocks of one key."""
    import pandas as pd

    fp = np.unique(rows["fp"].to_numpy())
    start = (int(rows["key"].iloc[0]) >> 5 * WIDTH) // 5
    bits = fp.view(np.uint64)
    near = np.empty((len(fp), len(fp)), dtype=bool)
    for at in range(0, len(fp), 256):
        near[at : at + 256] = _linked(bits[at : at + 256, None] ^ bits[None, :], start)
    root = np.full(len(fp), -1)
    for i in range(len(fp)):
        if root[i] < 0:
            root[i] = i
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & (root < 0))
                root[edge] = i
    far = root != np.arange(len(fp))
    return pd.DataFrame({"a": fp[far], "b": fp[root[far]]})


def _pair_links(batches):
    """The pairs (key, a, b) whose fingerprints are linked."""
    import pyarrow as pa

    for batch in batches:
        key, a, b = (batch.column(i).to_numpy() for i in range(3))
        start, bits, ok = (key >> 5 * WIDTH) // 5, (a ^ b).view(np.uint64), np.zeros(len(key), dtype=bool)
        for s in range(SEGMENTS):
            ok[start == s] = _linked(bits[start == s], s)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def links(nodes: DataFrame, few: int = 24, share: int = 1000) -> DataFrame:
    """(a, b): links between the distinct ``fp`` of ``nodes`` that connect what lies within ``TAU`` bits.

    Both ways make the same checks: pairs of a key with at most ``few`` fingerprints come from a join, others from blocks.
    """
    keyed = nodes.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = sizes.where(F.col("n") > max(BLOCK, nodes.count() // share))  # at most 24 * share keys, whatever the table
    rare = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(sizes, "key")
    small = rare.where(F.col("n") <= few).select("key", "fp")
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key").where("a < b").select("key", "a", "b").mapInArrow(_pair_links, "a long, b long")
    many = rare.where(F.col("n") > few).unionByName(keyed.join(F.broadcast(hot), "key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = many.select("key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    blocked = dealt.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long")
    return pairs.union(blocked).distinct()


def group(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the least doc_id
    that links of at most 3 bits reach, the row's own included. Rows without a word
    (null or empty texts among them) have fingerprint zero and are linked like any
    other. Repeated rows are returned as often as they occur; a null id is never
    least unless a whole component has only null ids. No rows give no rows.
    """
    return _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _grouped(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, root, component_id); ``root`` is one fingerprint of a component."""
    prints = cut(fingerprints(docs, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = nodes.join(components(links(nodes.select("fp"))), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = reach.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(reach.join(ids, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the least id, nulls last.

    Among rows that share it, the one with the least fingerprint and then the least hash of
    the whole row stays. Components whose least ids are alike keep a row each. Repeated
    rows are one; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).groupBy("h").agg(F.min("text").alias("text"))
    named = _grouped(texts.select(F.col("h").alias("doc_id"), "text"), words).select(F.col("doc_id").alias("_h"), "fp", "root")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"))
    slim = rows.select("_doc", "_hash").join(named, F.col("_hash") == F.col("_h"))
    least = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "fp", "_hash")).alias("head")
    heads = slim.groupBy("root").agg(least).select(F.col("head._doc").alias("_id"), F.col("head._hash").alias("_head"))
    chosen = rows.join(heads, (F.col("_hash") == F.col("_head")) & F.col("_doc").eqNullSafe(F.col("_id")))
    first = Window.partitionBy("_hash").orderBy(F.xxhash64(F.to_json("_row")))
    return chosen.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return group(table(spark, sf_dir, "documents")).drop("fp")
