"""Operator 6: sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards with weights. A row descends it:
at every level each child draws ``-ln(u) / weight`` with u hashed from the row's
key and the child's name, and the least draw wins. A draw depends on nothing but
that child, so changing a weight moves rows only into or out of the subtree that
holds it, and a new subtree takes rows only into itself. The draws are built-in
expressions, so placement needs no shuffle and no state.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 24, region: int = 8, rack: int = 4) -> list[Shard]:
    """Equal shards: the first ``base`` in regions of ``region`` and racks of ``rack``; each later one opens a region.

    With that, going from n to n + 1 shards (n >= base) moves rows only into the new shard.
    """
    whole = -(-min(shards, base) // region)
    return [Shard(s // region, s % region // rack, s) if s < base else Shard(whole + s - base, 0, s) for s in range(shards)]


def _least(key: Column, names: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least weighted draw; children of weight 0 never win."""
    live = [(n, w, v) for n, w, v in names if w > 0]
    if len(live) == 1:
        return live[0][2]

    def draw(name: str, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return -F.log(u) / F.lit(float(weight))

    return F.array_min(F.array(*(F.struct(draw(n, w).alias("d"), v.alias("v")) for n, w, v in live)))["v"]


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard of ``key`` as an int column; null if no shard has weight."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        return F.lit(None).cast("int")

    def level(members: list[Shard], depth: int, path: str) -> Column:
        if depth == 2:
            return _least(key, [(f"{path}/{s.shard}", s.weight, F.lit(s.shard)) for s in members])
        groups: dict[int, list[Shard]] = {}
        for s in members:
            groups.setdefault(s[depth], []).append(s)
        chosen = _least(key, [(f"{path}/{g}", sum(s.weight for s in m), F.lit(g)) for g, m in groups.items()])
        if len(groups) == 1:
            ((g, m),) = groups.items()
            return level(m, depth + 1, f"{path}/{g}")
        out = None
        for g, m in groups.items():
            below = level(m, depth + 1, f"{path}/{g}")
            out = F.when(chosen == g, below) if out is None else out.when(chosen == g, below)
        return out

    return level(live, 0, "").cast("int")


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8; ``slot`` numbers a
    shard's rows from 0 without gaps; ``grown_shard`` is the shard under the tree
    ``grown``. The id alone decides the shard (law ``key``): rows with a repeated
    id, or with a null one, share a shard, and equal texts need not. A null text has
    crc32 0, as the empty one. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    placed = rows.select("doc_id", (F.octet_length("_text") + 8).cast("long").alias("size"), F.crc32("_text").alias("text_crc32"), F.lit("key").alias("law"), descend(key, tree).alias("shard"), descend(key, grown).alias("grown_shard"))
    placed = cut(placed)
    return gapless(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", placed.count())


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return assign(table(spark, sf_dir, "documents"), topology(24), topology(25))
