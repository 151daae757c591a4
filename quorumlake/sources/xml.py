"""Landed XML documents by Spark's XML parser: explicit schemas, and a table of the documents that don't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

BROKEN = "_corrupt_record"

HOUSE = f"""`vote-metadata` STRUCT<session: STRING, `legis-num`: STRING, `vote-question`: STRING, `vote-desc`: STRING, `vote-result`: STRING, `action-date`: STRING,
    `vote-totals`: STRUCT<`totals-by-vote`: STRUCT<`yea-total`: STRING, `nay-total`: STRING, `present-total`: STRING, `not-voting-total`: STRING>>>,
  `vote-data` STRUCT<`recorded-vote`: ARRAY<STRUCT<legislator: STRUCT<`_name-id`: STRING>, vote: STRING>>>, {BROKEN} STRING"""

SENATE = f"""vote_date STRING, question STRING, vote_title STRING, vote_result STRING, count STRUCT<yeas: STRING, nays: STRING>,
  document STRUCT<document_type: STRING, document_number: STRING>, members STRUCT<member: ARRAY<STRUCT<last_name: STRING, state: STRING, vote_cast: STRING>>>, {BROKEN} STRING"""

MANIFEST = f"Member ARRAY<STRUCT<DocID: STRING, Last: STRING, First: STRING, FilingDate: STRING, StateDst: STRING>>, {BROKEN} STRING"


def parse_xml(raw: DataFrame, schema: str, col: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the document's fields under ``r`` beside the other columns; documents that don't parse, nulls among them, with their text."""
    parsed = raw.withColumn("r", F.from_xml(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    broken = F.col(col).isNull() | F.col(f"r.{BROKEN}").isNotNull()
    return parsed.where(~broken).drop(col), parsed.where(broken).drop("r")


def vote_id(chamber: str, congress: int, year: Column, roll: Column) -> Column:
    return F.concat_ws("-", F.lit(chamber), F.lit(congress).cast("string"), year.cast("string"), roll.cast("string"))


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


def house_rolls(raw: DataFrame, congress: int, col: str = "xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ballots, positions, rejected) of House roll calls (year, roll, xml).

    Totals are those by vote, 0 where there is none. A date that cannot be read is the
    first of the year. A call by States without a yea or nay is no ballot; its positions
    are left out too. ``item_id`` is the item that the legislation's number names.
    """
    rows, rejected = parse_xml(raw, HOUSE, col)
    meta = F.col("r.vote-metadata")
    totals = meta["vote-totals"]["totals-by-vote"]
    ballots = rows.select(
        vote_id("house", congress, F.col("year"), F.col("roll")).alias("vote_id"),
        F.coalesce(S.parse_ballot_date(meta["action-date"]), F.make_date("year", F.lit(1), F.lit(1))).alias("ballot_date"),
        meta["vote-question"].alias("question"), meta["vote-desc"].alias("description"), meta["vote-result"].alias("result"),
        S.item_from_text(meta["legis-num"], F.lit(congress)).alias("item_id"),
        *(_number(totals[f"{k}-total"]).alias(name) for k, name in (("yea", "yeas"), ("nay", "nays"), ("present", "present"), ("not-voting", "not_voting"))),
        F.col("r.vote-data.recorded-vote").alias("votes"),
    )
    ballots = ballots.where(~((F.col("yeas") == 0) & (F.col("nays") == 0) & F.coalesce(F.col("question") == "Call by States", F.lit(False))))
    votes = ballots.select("vote_id", F.explode("votes").alias("v"))
    return ballots.drop("votes"), votes.select("vote_id", F.col("v.legislator._name-id").alias("entity_id"), S.norm_position(F.col("v.vote")).alias("position")), rejected


def senate_rolls(raw: DataFrame, lookup: DataFrame, order: list, congress: int, col: str = "xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ballots, positions, rejected) of Senate roll calls (year, roll, xml), whose members go by name and state.

    A date that cannot be read is the first of the year. ``item_id`` is made of the
    document's type and number, if both are there. Members are found by last name, in
    lower case, and state in ``lookup`` (entity_id, last_name, state), whose first row
    of a key in ``order`` counts; others are dropped.
    """
    rows, rejected = parse_xml(raw, SENATE, col)
    kind, number = F.lower(F.regexp_replace("r.document.document_type", r"[\s.]", "")), F.trim("r.document.document_number")
    ballots = rows.select(
        vote_id("senate", congress, F.col("year"), F.col("roll")).alias("vote_id"),
        F.coalesce(S.parse_ballot_date(F.col("r.vote_date")), F.make_date("year", F.lit(1), F.lit(1))).alias("ballot_date"),
        F.col("r.question").alias("question"), F.nullif("r.vote_title", F.lit("")).alias("description"), F.col("r.vote_result").alias("result"),
        F.when((kind != "") & (number != ""), F.concat_ws("-", kind, number, F.lit(congress).cast("string"))).alias("item_id"),
        _number(F.col("r.count.yeas")).alias("yeas"), _number(F.col("r.count.nays")).alias("nays"),
    )
    key = lambda last, state: F.concat(F.lower(F.trim(last)), F.lit("-"), F.trim(state))
    known = lookup.withColumn("_key", key(F.col("last_name"), F.col("state")))
    known = known.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").select("_key", "entity_id")
    votes = rows.select(vote_id("senate", congress, F.col("year"), F.col("roll")).alias("vote_id"), F.explode("r.members.member").alias("m"))
    named = votes.select("vote_id", key(F.col("m.last_name"), F.col("m.state")).alias("_key"), S.norm_position(F.col("m.vote_cast")).alias("position"))
    return ballots, named.join(known, "_key").select("vote_id", "entity_id", "position"), rejected


def manifest(raw: DataFrame, col: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(filings, rejected documents) of index documents (xml): one filing a member."""
    rows, rejected = parse_xml(raw, MANIFEST, col)
    m = rows.select(F.explode("r.Member").alias("m")).select("m.*")
    district = F.regexp_extract("StateDst", r"(\d+)$", 1).try_cast("int")
    return m.select(F.col("DocID").alias("doc_id"), F.col("Last").alias("last"), F.col("First").alias("first"), S.parse_us_date(F.col("FilingDate")).alias("filed_date"), F.substring("StateDst", 1, 2).alias("state"), district.alias("district")), rejected
