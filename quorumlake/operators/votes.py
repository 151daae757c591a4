"""Ballots and positions: agreement, summaries, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import percent


WORDS = 16  # of 64 ballots each: the most ballots of one block of bit sets; so many fit compiled code
DEAR = 8  # bit sets compared in the time of one row of joined votes
PARTS, MOST = 32, 16_384  # parts of the entities, and more where a part would have more than so many
COUNTED = 1_000_000  # rows that a tile adds up


def pairwise_agreement(position: DataFrame, entities: DataFrame | None = None, block: int = 500, dense: bool | None = None) -> DataFrame:
    """(a, b, shared, agreed, pct) for every pair that both voted yea or nay on a ballot.

    An entity has one position on a ballot. Where most entities vote on most ballots, an
    entity's votes of a block of ballots are two bit sets, and a pair is one row a block
    whose bits are counted; where votes are scattered, the two votes of a ballot are
    joined. What costs less is taken, unless ``dense`` says so. ``entities``
    restricts both sides. More than ``block`` entities are dealt into parts, and every two
    parts meet in a tile of their own, which has all that their pairs share. So pairs are
    counted where they are formed and never shuffled; what is shuffled are the votes,
    once for each part.
    """
    votes = position.where(F.col("position").isin("yea", "nay") & F.col("ballot_id").isNotNull() & F.col("entity_id").isNotNull()).select("ballot_id", "entity_id", (F.col("position") == "yea").alias("yea"))
    if entities is not None:
        votes = votes.join(entities.select("entity_id"), "entity_id", "left_semi")
    ballots = votes.groupBy("ballot_id").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col("entity_id").cast("string")).alias("who"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    size = ballots.agg(F.count("*").alias("ballots"), total(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.hll_sketch_estimate(F.hll_union_agg("who")).alias("crowd")).first()
    blocks = 1 if size.ballots <= 64 * WORDS else -(-size.ballots // (WORDS * 50))
    crowd = size.crowd or 0
    if dense is None:
        dense = blocks * crowd**2 <= DEAR * size.pairs
    summed = 0 if dense and blocks == 1 else min(blocks * crowd**2 if dense else size.pairs, size.pairs) // 2
    parts = max(1, min(PARTS, -(-crowd // block)), -(-crowd // MOST), round((2 * summed / COUNTED) ** 0.5))
    out = _by_bits(votes, ballots.select("ballot_id"), size.ballots, blocks, parts) if dense else _by_ballot(votes, parts)
    return out.withColumn("pct", F.expr("(200 * agreed + shared) div (2 * shared)"))  # rounded, in whole numbers


def _meeting(rows: DataFrame, parts: int, keys: list[str], columns: list[str], on: Column | None = None) -> DataFrame:
    """Every two entities' rows with equal ``keys``, once: x, y and their ``columns`` as x_... and y_...; pairs of two parts come in one ``tile`` and one task.

    ``on`` is a condition on those columns. With ``keys`` the rows of a key in a tile are two
    lists, as a join would be dealt out by tile and key.
    """
    own, tile = F.pmod(F.xxhash64("entity_id"), F.lit(parts)).cast("int"), F.expr("_high * (_high + 1) div 2 + _low").cast("int")
    apart, tiles = F.col("_low") < F.col("_high"), parts * (parts + 1) // 2
    meet = F.col("_apart") | (F.col("x") < F.col("y"))
    named = lambda n: [F.col("entity_id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in columns)]
    if keys:
        dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
        side = lambda n, part: F.collect_list(F.when(F.col("_own") == F.col(part), F.struct(*named(n)))).alias(f"_{n}")
        lists = dealt.withColumn("tile", tile).repartition(tiles, "tile").groupBy("tile", *keys).agg(F.first(apart).alias("_apart"), side("x", "_low"), side("y", "_high"))
        met = lists.select("tile", "_apart", "_y", F.inline("_x")).select("*", F.inline("_y")).drop("_y")
    else:
        x = rows.withColumn("_low", own).withColumn("_high", F.explode(F.sequence(own, F.lit(parts - 1)))).select(tile.alias("tile"), apart.alias("_apart"), *named("x")).repartition(tiles, "tile")
        y = rows.withColumn("_high", own).withColumn("_low", F.explode(F.sequence(F.lit(0), own))).select(tile.alias("tile"), *named("y")).repartition(tiles, "tile")
        met = x.join(y, "tile")
    return met.where(meet if on is None else meet & on)


def _pairs(met: DataFrame, agreed: Column, shared: Column) -> DataFrame:
    return met.select("tile", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), shared.cast("long").alias("shared"), agreed.cast("long").alias("agreed"))


def _added(pairs: DataFrame) -> DataFrame:
    """A row a pair; as its rows are in one tile, none is shuffled."""
    return pairs.groupBy("tile", "a", "b").agg(F.sum("shared").alias("shared"), F.sum("agreed").alias("agreed"))


def _by_ballot(votes: DataFrame, parts: int) -> DataFrame:
    met = _meeting(votes, parts, ["ballot_id"], ["yea"])
    return _added(_pairs(met, F.col("x_yea") == F.col("y_yea"), F.lit(1))).drop("tile")


def _by_bits(votes: DataFrame, ballots: DataFrame, count: int, blocks: int, parts: int) -> DataFrame:
    words = range(WORDS if blocks > 1 else max(1, -(-count // 64)))
    size = 64 * len(words)
    place = F.pmod(F.xxhash64("ballot_id"), F.lit(blocks))
    number = F.row_number().over(Window.partitionBy("_place").orderBy("ballot_id")) - 1  # a place has about WORDS * 50 ballots
    numbered = ballots.withColumn("_place", place).withColumn("_n", number).select("ballot_id", (F.col("_place") + blocks * F.floor(F.col("_n") / size)).alias("part"), (F.col("_n") % size).alias("bit"))
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    sets = [F.coalesce(F.bit_or(F.when(F.col(side) & (F.floor(F.col("bit") / 64) == w), one)), F.lit(0)).alias(f"{side}{w}") for side in ("voted", "yea") for w in words]
    held = votes.withColumn("voted", F.lit(True)).join(numbered, "ballot_id").groupBy("part", "entity_id").agg(*sets)
    both = [F.col(f"x_voted{w}").bitwiseAND(F.col(f"y_voted{w}")) for w in words]
    same = [b.bitwiseAND(F.bitwise_not(F.col(f"x_yea{w}").bitwiseXOR(F.col(f"y_yea{w}")))) for b, w in zip(both, words)]
    keys, columns = ["part"] if blocks > 1 else [], [f"{side}{w}" for side in ("voted", "yea") for w in words]
    met = _meeting(held, parts, keys, columns, reduce(Column.bitwiseOR, both) != 0)
    bits = lambda sets: reduce(Column.__add__, map(F.bit_count, sets))
    pairs = _pairs(met, bits(same), bits(both))
    return (_added(pairs) if blocks > 1 else pairs).drop("tile")


def position_summary(position: DataFrame) -> DataFrame:
    """Counts by position and their shares for every entity; unknown positions count as not voting."""
    kinds = ("yea", "nay", "present")
    out = position.groupBy("entity_id").agg(*(F.count_if(F.col("position") == k).alias(k) for k in kinds), F.count_if(~F.col("position").isin(*kinds)).alias("not_voting"), F.count("*").alias("total"))
    return out.select("*", *(percent(F.col(k), F.col("total")).alias(f"{k}_pct") for k in (*kinds, "not_voting")))


def group_ballots(ballot: DataFrame, position: DataFrame, entity: DataFrame) -> DataFrame:
    """(group_id, ballot_id) where an active entity of the group took part."""
    active = entity.where("in_office").select("entity_id", "group_id")
    return position.join(active, "entity_id").select("group_id", "ballot_id").distinct().join(ballot, "ballot_id", "left_semi")


def ballot_events(ballot: DataFrame, position: DataFrame, entity: DataFrame, newest: int = 100) -> DataFrame:
    """What each group's delegation did on the newest ballots: one row a ballot and group."""
    recent = ballot.orderBy(F.desc("ballot_date"), F.desc("ballot_id")).limit(newest)
    rows = position.join(F.broadcast(recent.select("ballot_id")), "ballot_id").join(entity.where("in_office").select("entity_id", "group_id"), "entity_id")
    c = rows.groupBy("ballot_id", "group_id").agg(F.count_if(F.col("position") == "yea").alias("yea"), F.count_if(F.col("position") == "nay").alias("nay"), F.count("*").alias("total"))
    text = F.when(F.col("yea") == F.col("total"), "Unanimous Yea").when(F.col("nay") == F.col("total"), "Unanimous Nay").otherwise(F.concat(F.col("yea").cast("string"), F.lit(" Yea, "), F.col("nay").cast("string"), F.lit(" Nay")))
    return c.withColumn("title", text)
