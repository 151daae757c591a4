"""The event table of groups: items introduced and ballots taken, and a group's newest of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import chamber_label
from .core import topk_per_key

COLUMNS = ["group_id", "event_type", "related_id", "entity_id", "title", "event_date"]


def item_events(item_link: DataFrame, item: DataFrame, entity: DataFrame, newest: int = 500) -> DataFrame:
    """One event for each sponsor of the newest dated items; as many rows as ``newest`` at most, which is the feature."""
    rows = item_link.where("role = 'sponsor'").select("item_id", "entity_id").join(item.where("introduced_date IS NOT NULL"), "item_id")
    recent = rows.join(entity.select("entity_id", "group_id", "full_name"), "entity_id").orderBy(F.desc("introduced_date"), "item_id", "entity_id").limit(newest)
    title = F.concat("full_name", F.lit(" introduced "), F.upper("item_type"), F.lit(" "), F.col("item_id").cast("string"))
    return recent.select("group_id", F.lit("bill_introduced").alias("event_type"), F.col("item_id").cast("string").alias("related_id"), "entity_id", title.alias("title"), F.col("introduced_date").alias("event_date"))


def ballot_events(ballot: DataFrame, position: DataFrame, entity: DataFrame, newest: int = 100) -> DataFrame:
    """One event for each group whose entities took part in one of the newest ballots (ballot_id, ballot_date, related_id, chamber, subject)."""
    recent = ballot.orderBy(F.desc("ballot_date"), F.desc("ballot_id")).limit(newest)
    votes = position.join(F.broadcast(recent), "ballot_id").join(entity.select("entity_id", "group_id"), "entity_id")  # `newest` rows
    is_ = lambda p: F.count_if(F.col("position") == p)
    sums = votes.groupBy("ballot_id", "ballot_date", "related_id", "chamber", "subject", "group_id").agg(is_("yea").alias("yea"), is_("nay").alias("nay"), F.count("*").alias("total"))
    all_ = lambda side: F.lit(f" vote: delegation voted unanimously {side} on ")
    how = F.when(F.col("yea") == F.col("total"), all_("Yea")).when(F.col("nay") == F.col("total"), all_("Nay")).otherwise(F.concat(F.lit(" vote: "), F.col("yea").cast("string"), F.lit(" Yea, "), F.col("nay").cast("string"), F.lit(" Nay on ")))
    title = F.concat(chamber_label(F.col("chamber")), how, "subject")
    nobody = F.lit(None).cast(entity.schema["entity_id"].dataType).alias("entity_id")
    return sums.select("group_id", F.lit("vote_cast").alias("event_type"), "related_id", nobody, title.alias("title"), F.col("ballot_date").alias("event_date"))


def group_activity(events: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` newest events of every group, whatever their kind."""
    order = [F.desc("event_date"), F.asc("event_type"), F.asc("related_id"), F.asc("entity_id")]
    return topk_per_key(events, ["group_id"], order, k, "rank").select(*COLUMNS, "rank")
