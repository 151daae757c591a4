"""Entities, groups, committees, items, finance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import effective_total
from .core import latest_per_key, ranked, topk_per_key


def category_breakdown(group_dim: DataFrame, entity: DataFrame) -> DataFrame:
    """Active entities of each group by party; groups without any are kept with zeros."""
    e = entity.where("in_office").groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.col("party") == "Democrat").alias("democrats"), F.count_if(F.col("party") == "Republican").alias("republicans"), F.count_if(~F.col("party").isin("Democrat", "Republican")).alias("others"))
    return group_dim.join(e, "group_id", "left").select("group_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "democrats", "republicans", "others")))


def party_share(breakdown: DataFrame) -> DataFrame:
    """Shares in whole percent and the dominance class of each group."""
    n = F.nullif(F.col("members"), F.lit(0))
    top = F.greatest("democrats", "republicans") / n
    side = F.when(F.col("democrats") > F.col("republicans"), "D").when(F.col("democrats") < F.col("republicans"), "R")
    lean = F.when(F.col("members") == 0, "none").when(side.isNotNull() & (top > 0.65), F.concat(F.lit("strong_"), side)).when(side.isNotNull() & (top > 0.5), F.concat(F.lit("lean_"), side)).otherwise("split")
    return breakdown.select("group_id", *(F.coalesce(F.round(100 * F.col(c) / n), F.lit(0)).cast("long").alias(f"{c}_pct") for c in ("democrats", "republicans", "others")), lean.alias("dominance"))


def role_counts(item_link: DataFrame) -> DataFrame:
    return item_link.groupBy("entity_id").agg(F.count_if(F.col("role") == "sponsor").alias("sponsored"), F.count_if(F.col("role") == "cosponsor").alias("cosponsored"))


def committee_coverage(entity: DataFrame, assignment: DataFrame, committee: DataFrame) -> DataFrame:
    """Active entities on top-level committees."""
    top = committee.where("parent_id IS NULL").select("committee_id", "name")
    return entity.where("in_office").select("entity_id", "group_id", "full_name").join(assignment, "entity_id").join(top, "committee_id")


def committee_board(coverage: DataFrame, first: int = 12) -> DataFrame:
    """Per group and committee: the first members by name and how many more there are.

    Ranks are cut on the map side; the counts come from an aggregate of their own.
    """
    keys = ["group_id", "committee_id"]
    top = topk_per_key(coverage.select(*keys, "name", "full_name", "entity_id"), keys, [F.asc("full_name"), F.asc("entity_id")], first, "rn")
    shown = top.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("rn", "full_name"))).alias("m"))  # `first` names
    sizes = coverage.groupBy(*keys).agg(F.count("*").alias("n"))
    return shown.join(sizes, keys).select(*keys, "name", F.array_join("m.full_name", "; ").alias("members"), F.greatest(F.lit(0), F.col("n") - first).alias("more"))


def subcommittees(committee: DataFrame, prefix: int = 3) -> DataFrame:
    """(parent, child): children attach by the fixed-length id prefix, an equi-join."""
    parents = committee.where("parent_id IS NULL").select(F.col("committee_id").alias("parent"))
    return committee.where("parent_id IS NOT NULL").select(F.col("committee_id").alias("child"), F.substring("committee_id", 1, prefix).alias("parent")).join(parents, "parent")


def latest_finance(finance: DataFrame) -> DataFrame:
    """The newest cycle of each entity with its effective total."""
    new = latest_per_key(finance, ["entity_id"], [F.desc("cycle")])
    return new.withColumn("effective_total", effective_total(F.col("total_receipts"), F.col("total_individual"), F.col("small_individual"), F.col("total_pac")))


def funding_mix(latest: DataFrame) -> DataFrame:
    """Small, large and PAC money with their shares of the effective total."""
    large = F.greatest(F.lit(0), F.col("total_individual") - F.col("small_individual"))
    share = lambda c: F.when(F.col("effective_total") > 0, F.round(100 * c / F.col("effective_total"))).otherwise(0).cast("long")
    return latest.select("entity_id", "cycle", F.col("small_individual").alias("small"), large.alias("large"), F.col("total_pac").alias("pac"), share(F.col("small_individual")).alias("small_pct"), share(large).alias("large_pct"), share(F.col("total_pac")).alias("pac_pct"))


def coverage_flags(entity: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Per entity and source ``good`` or ``none``, by one tagged union and one aggregation."""
    tagged = None
    for name, df in sources.items():
        one = df.select("entity_id", F.lit(name).alias("s"))
        tagged = one if tagged is None else tagged.union(one)
    has = tagged.groupBy("entity_id").agg(*(F.bool_or(F.col("s") == n).alias(f"_{n}") for n in sources))
    return entity.select("entity_id").join(has, "entity_id", "left").select("entity_id", *(F.when(F.col(f"_{n}"), "good").otherwise("none").alias(n) for n in sources))


def top_sponsors(entity: DataFrame, item_link: DataFrame, k: int = 3, by_name: bool = False) -> DataFrame:
    """The ``k`` active entities of each group with most sponsored items; ``by_name`` merges namesakes."""
    keys = ["group_id", "full_name"] if by_name else ["group_id", "entity_id", "full_name"]
    n = entity.where("in_office").join(item_link.where("role = 'sponsor'"), "entity_id").groupBy(*keys).agg(F.count("*").alias("items"))
    return topk_per_key(n, ["group_id"], [F.desc("items"), *(F.col(k) for k in reversed(keys))], k, "rank")


def find_delegation(addresses: DataFrame, entity: DataFrame) -> DataFrame:
    """Per (group_id, district): the representative of the district, else the one at large (district 0)."""
    reps = entity.where("in_office AND chamber = 'house'").select("group_id", F.col("district").alias("seat"), "entity_id")
    hits = addresses.join(reps, "group_id").where((F.col("seat") == F.col("district")) | (F.col("seat") == 0))
    return latest_per_key(hits, ["group_id", "district"], [(F.col("seat") != F.col("district")).asc(), F.col("entity_id").asc()])


def by_code(groups: DataFrame, codes: DataFrame, col: str = "name") -> DataFrame:
    """Groups whose code is among ``codes`` (code), which may be in lower case."""
    return groups.join(codes.select(F.upper("code").alias(col)), col, "left_semi")


def top_contributors(contributor: DataFrame, cycle: int | None = None, k: int = 10) -> DataFrame:
    """The ``k`` largest contributors of each entity, of one cycle if it is given."""
    rows = contributor if cycle is None else contributor.where(F.col("cycle") == cycle)
    sums = rows.groupBy("entity_id", "contributor_name").agg(F.sum("total_amount").alias("total_amount"))
    return topk_per_key(sums, ["entity_id"], [F.desc("total_amount"), F.asc("contributor_name")], k, "rank")


def finance_board(entity: DataFrame, latest: DataFrame) -> DataFrame:
    """Active entities with their chamber and the effective total of their latest cycle, ranked in their group; without finance the total is null and last."""
    total = effective_total(F.col("total_receipts"), F.col("total_individual"), F.col("small_individual"), F.col("total_pac"))
    money = latest.select("entity_id", total.alias("total"))
    rows = entity.where("in_office").join(money, "entity_id", "left").select("group_id", "entity_id", "chamber", "total")
    return ranked(rows, ["group_id"], [F.desc_nulls_last("total"), F.asc("entity_id")], "rank")


def share_of_max(entity: DataFrame, latest: DataFrame, least: int = 3) -> DataFrame:
    """Active entities' bars: their effective total in percent of the group's largest, ``least`` at least; null if that is none."""
    rows = entity.where("in_office").select("entity_id", "group_id").join(latest.select("entity_id", "effective_total"), "entity_id")
    most = rows.groupBy("group_id").agg(F.nullif(F.max("effective_total"), F.lit(0)).alias("most"))
    bar = F.greatest(F.lit(least).cast("long"), F.round(F.lit(100.0) * F.col("effective_total") / F.col("most")).cast("long"))
    return rows.join(most, "group_id").select("group_id", "entity_id", bar.alias("bar"))
