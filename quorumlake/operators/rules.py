"""Rules as rows, checked together: one pass for the rules of a row, one aggregate or anti join for each that looks at others."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind``: required, accepted (``values``), longest (``size``), between (``low``, ``high``), unique, key (in ``parent``'s ``parent_columns``)."""

    name: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    size: int = 0
    low: object = None
    high: object = None
    parent: DataFrame | None = field(default=None, compare=False)
    parent_columns: tuple[str, ...] = ()


def _broken(rule: Rule) -> Column:
    """Whether a row breaks a rule of its own; as in SQL checks, nulls only break ``required``."""
    col = F.col(rule.columns[0])
    if rule.kind == "required":
        return col.isNull()
    if rule.kind == "accepted":
        return ~col.isin(*rule.values)
    if rule.kind == "longest":
        return F.length(col.cast("string")) > rule.size
    if rule.kind == "between":
        return ~col.between(rule.low, rule.high)
    raise ValueError(f"no rule of a row: {rule.kind}")


def check(rows: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(rule, key, n): every breach, ``key`` being the row's key columns as text, joined by ``/``.

    A ``unique`` rule names each repeated value once, with its ``n`` rows, and takes
    rows with a null in its columns as different, as in SQL; a ``key`` rule lets nulls
    pass. ``n`` is 1 for the other kinds.
    """
    text = lambda columns: F.concat_ws("/", *(F.col(c).cast("string") for c in columns))
    own = [r for r in rules if r.kind not in ("unique", "key")]
    parts = []
    if own:
        found = F.array_compact(F.array(*(F.when(_broken(r), F.lit(r.name)) for r in own)))
        parts.append(rows.select(F.explode(found).alias("rule"), text(key).alias("key"), F.lit(1).cast("long").alias("n")))
    for r in rules:
        whole = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in r.columns)))
        if r.kind == "unique":
            repeated = whole.groupBy(*r.columns).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(repeated.select(F.lit(r.name).alias("rule"), text(r.columns).alias("key"), "n"))
        elif r.kind == "key":
            known = r.parent.select(*(F.col(p).alias(c) for p, c in zip(r.parent_columns or r.columns, r.columns, strict=True)))
            parts.append(whole.join(known, list(r.columns), "left_anti").select(F.lit(r.name).alias("rule"), text(key).alias("key"), F.lit(1).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
