"""Side-by-side profiles of entities, delegations and groups, and the written brief of each group."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import effective_total, fmt_money, percent, stats_json
from .people import funding_mix, latest_finance, role_counts, top_sponsors
from .votes import position_summary

TASKS = 1000  # the most that write briefs
LEADERS = ("chair", "ranking_member", "vice_chair")
BRIEF_MEASURES = ["members", "senators", "representatives", "democrats", "republicans", "items", "raised", "positions", "seats", "leadership"]
# The fields of a brief's statistics and the columns they hold.
BRIEF_STATS = [("members", "members"), ("senators", "senators"), ("representatives", "representatives"), ("democrat", "democrats"), ("republican", "republicans"), ("billsSponsored", "items"), ("totalRaised", "raised"), ("totalVotes", "positions"), ("committeeSeats", "seats"), ("leadershipRoles", "leadership")]


def _filled(df: DataFrame, parts: list[DataFrame], key: str, zeros: list[str]) -> DataFrame:
    """``df`` with each part joined on ``key``; the columns ``zeros`` are 0 where a part has no row."""
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, df)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zeros})


def profiles(entity: DataFrame, item_link: DataFrame, position: DataFrame, finance: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row an active entity: role counts, position totals, newest finance with its mix, top-level committees.

    Counts are 0 where an entity has no such rows; its finance columns are null then.
    """
    new = latest_finance(finance)
    mix = funding_mix(new).select("entity_id", "cycle", "small_pct", "large_pct", "pac_pct").join(new.select("entity_id", "effective_total"), "entity_id")
    votes = position_summary(position).select("entity_id", "yea", "nay", "total")
    seats = coverage.groupBy("entity_id").agg(F.count_distinct("committee_id").alias("committees"))
    base = entity.where("in_office").select("entity_id", "group_id", "full_name", "chamber", "party")
    return _filled(base, [role_counts(item_link), votes, mix, seats], "entity_id", ["sponsored", "cosponsored", "yea", "nay", "total", "committees"])


def agreement_of(pairs: DataFrame, position: DataFrame) -> DataFrame:
    """(a, b, shared, agreed, pct) of the given pairs only: no other pair is formed."""
    votes = position.where(F.col("position").isin("yea", "nay"))
    a, b = (votes.select("ballot_id", F.col("entity_id").alias(n), F.col("position").alias(f"p{n}")) for n in "ab")
    both = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "ballot_id"])
    out = both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("pa") == F.col("pb")).alias("agreed"))
    return out.withColumn("pct", percent(F.col("agreed"), F.col("shared")))


def compare_entities(pairs: DataFrame, profile: DataFrame, position: DataFrame) -> DataFrame:
    """Each pair (a, b) with both profiles (``a_...``, ``b_...``) and, within one chamber, its agreement.

    Pairs of which one is not in ``profile`` are left out; without a shared ballot the
    agreement columns are null.
    """
    side = lambda n: profile.select(F.col("entity_id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in profile.columns if c != "entity_id"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    agree = agreement_of(both.where("a_chamber = b_chamber"), position)
    return both.join(agree, ["a", "b"], "left")


def compare_delegation(profile: DataFrame, position: DataFrame) -> DataFrame:
    """Every group's roster; where it has exactly two senators, their agreement on each of its rows."""
    senators = profile.where("chamber = 'senate'").groupBy("group_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("a"), F.max("entity_id").alias("b")).where("n = 2")
    agree = senators.join(agreement_of(senators, position), ["a", "b"]).select("group_id", F.col("shared").alias("senators_shared"), F.col("pct").alias("senators_pct"))
    return profile.join(agree, "group_id", "left")


def _sizes(entity: DataFrame) -> DataFrame:
    party = F.col("party")
    return entity.where("in_office").groupBy("group_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("chamber") == "senate").alias("senators"), F.count_if(F.col("chamber") == "house").alias("representatives"),
        F.count_if(party == "Democrat").alias("democrats"), F.count_if(party == "Republican").alias("republicans"), F.count_if(~F.coalesce(party.isin("Democrat", "Republican"), F.lit(False))).alias("others"),
    )


def group_rollup(group_dim: DataFrame, entity: DataFrame, item_link: DataFrame, finance: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row a group: size, parties, sponsored items, money, committee seats.

    An entity's money is the largest effective total of its cycles. Each measure is
    aggregated before it is joined, so none multiplies another. ``average_raised`` is
    null for a group without finance rows; all other measures are 0.
    """
    active = entity.where("in_office").select("entity_id", "group_id")
    items = active.join(item_link.where("role = 'sponsor'"), "entity_id").groupBy("group_id").agg(F.count("*").alias("items"))
    top = finance.groupBy("entity_id").agg(F.max(effective_total(F.col("total_receipts"), F.col("total_individual"), F.col("small_individual"), F.col("total_pac"))).alias("raised"))
    money = active.join(top, "entity_id").groupBy("group_id").agg(F.sum("raised").alias("raised"), F.count("*").alias("with_finance"))
    seats = coverage.groupBy("group_id").agg(F.count("*").alias("seats"), F.count_distinct("committee_id").alias("committees"))
    counts = ["members", "senators", "representatives", "democrats", "republicans", "others", "items", "raised", "with_finance", "seats", "committees"]
    out = _filled(group_dim.select("group_id", "name"), [_sizes(entity), items, money, seats], "group_id", counts)
    return out.withColumn("average_raised", F.when(F.col("with_finance") > 0, F.round(F.col("raised") / F.col("with_finance"))).cast("long"))


def _duties(entity: DataFrame, assignment: DataFrame, committee: DataFrame) -> DataFrame:
    """(group_id, full_name, leadership, duties): what the active entities of a name lead in a group, as one text by committee and role."""
    top = committee.where("parent_id IS NULL").select("committee_id", "name")
    roles = assignment.where(F.col("role").isin(*LEADERS)).join(top, "committee_id").groupBy("entity_id").agg(F.collect_list(F.struct("name", "role")).alias("roles"))
    named = entity.where("in_office").select("entity_id", "group_id", "full_name").join(roles, "entity_id").groupBy("group_id", "full_name").agg(F.sort_array(F.flatten(F.collect_list("roles"))).alias("roles"))
    duty = lambda x: F.concat("full_name", F.lit(" ("), F.replace(x["role"], F.lit("_"), F.lit(" ")), F.lit(" of "), x["name"], F.lit(")"))
    return named.select("group_id", "full_name", F.size("roles").cast("long").alias("leadership"), F.array_join(F.transform("roles", duty), "; ").alias("duties"))


def _measures(group_dim: DataFrame, entity: DataFrame, item_link: DataFrame, finance: DataFrame, position: DataFrame, assignment: DataFrame, duties: DataFrame) -> DataFrame:
    """One row a group with active members: what a brief tells of it in numbers, and its top sponsors."""
    active = entity.where("in_office").select("entity_id", "group_id")
    per_group = lambda df, name: active.join(df.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id").groupBy("group_id").agg(F.sum("n").alias(name))
    new = active.join(latest_finance(finance), "entity_id").groupBy("group_id").agg(F.sum("total_receipts").alias("raised"), F.sum("total_pac").alias("pac"), F.sum("small_individual").alias("small"))
    top = top_sponsors(entity, item_link, by_name=True)
    named = F.concat("full_name", F.lit(" ("), F.col("items").cast("string"), F.lit(")"))
    sponsors = top.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", named.alias("t"))))["t"], ", ").alias("top"))
    led = duties.groupBy("group_id").agg(F.sum("leadership").alias("leadership"))
    parts = [per_group(item_link.where("role = 'sponsor'"), "items"), sponsors, new, per_group(position, "positions"), per_group(assignment, "seats"), led]
    return _filled(_sizes(entity).join(group_dim.select("group_id", "name"), "group_id"), parts, "group_id", ["items", "raised", "pac", "small", "positions", "seats", "leadership"])


def delegation_stats(group_dim: DataFrame, entity: DataFrame, item_link: DataFrame, finance: DataFrame, position: DataFrame, assignment: DataFrame, committee: DataFrame) -> DataFrame:
    """(group_id, stats): the statistics of each group's brief, without its text."""
    b = _measures(group_dim, entity, item_link, finance, position, assignment, _duties(entity, assignment, committee))
    return b.select("group_id", stats_json(**{name: F.col(c) for name, c in BRIEF_STATS}).alias("stats"))


def _alone(spark: SparkSession) -> ResourceProfile | None:
    """A profile of tasks of which an executor runs one at a time, where that can be told."""
    conf, master = spark.sparkContext.getConf(), spark.sparkContext.master
    cluster = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*\]", master)
    cores = int(cluster[1] if cluster else conf.get("spark.executor.cores", "0"))
    if cores < 2 or re.fullmatch(r"local(\[.*\])?", master) or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def _written(columns: list[str]) -> Callable[[Iterable], Iterator]:
    """Batches of groups' first rows, each before its pieces in order, to a row a group of ``columns`` and its summary; only the text at work is held."""

    def texts(batches: Iterable) -> Iterator:
        import pyarrow as pa

        first, text = None, bytearray()

        def whole():  # the summary refers to ``text``
            text.extend(first["tail" if text else "plain"][0].as_py().encode())
            summary = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(struct.pack("=2i", 0, len(text))), pa.py_buffer(text)])
            return pa.RecordBatch.from_arrays([*(first[c] for c in columns), summary], names=[*columns, "summary"])

        for batch in batches:
            starts = [i for i, is_first in enumerate(batch["first"].to_pylist()) if is_first]
            for i, j in zip([0, *starts], [*starts, batch.num_rows]):
                rows = batch.slice(i, j - i)  # none before the first start
                if i in starts and rows.num_rows:
                    if first is not None:
                        yield whole()
                    first, text, rows = pa.RecordBatch.from_pylist(rows.slice(0, 1).to_pylist(), schema=rows.schema), bytearray(), rows.slice(1)
                pieces = [x for x in rows["duties"].to_pylist() if x]
                if pieces:
                    text += (("; " if text else first["head"][0].as_py()) + "; ".join(pieces)).encode()
        if first is not None:
            yield whole()

    return texts


def delegation_brief(group_dim: DataFrame, entity: DataFrame, item_link: DataFrame, finance: DataFrame, position: DataFrame, assignment: DataFrame, committee: DataFrame, as_of: str, congress: int = 119) -> DataFrame:
    """One row a group with active members: its measures and a written summary for the week up to ``as_of``.

    ``group_dim`` has a group once. Money is the newest cycle's plain receipts. Sentences without content are left out.
    Names are listed by count or alphabet, so that equal inputs give equal texts. As a
    summary has all leadership roles of a group, it can be long: roles are written by name,
    and these pieces are sorted and put together as they come. Each copy of a long text counts
    in that last stage, which also stores it, so an executor runs one of its tasks at a time.
    """
    duties = _duties(entity, assignment, committee)
    b = _measures(group_dim, entity, item_link, finance, position, assignment, duties)

    num = lambda c: F.col(c).cast("string")
    many = lambda c, word: F.concat(num(c), F.lit(f" {word}"), F.when(F.col(c) == 1, "").otherwise("s"))
    d, r = F.col("democrats"), F.col("republicans")
    lead = (
        F.when(d == r, "evenly split between parties")
        .when(d > r, F.concat(F.lit("majority Democrat ("), num("democrats"), F.lit("D-"), num("republicans"), F.lit("R)")))
        .otherwise(F.concat(F.lit("majority Republican ("), num("republicans"), F.lit("R-"), num("democrats"), F.lit("D)")))
    )
    before = [
        F.concat("name", F.lit("'s delegation has "), many("senators", "senator"), F.lit(" and "), many("representatives", "representative"), F.lit(", "), lead, F.lit(".")),
        F.when(F.col("items") > 0, F.concat(F.lit("The delegation has sponsored "), num("items"), F.lit(f" bills in the {congress}th Congress."))),
        F.when(F.col("items") > 0, F.concat(F.lit("Most active sponsors: "), "top", F.lit("."))),
        F.when(F.col("raised") > 0, F.concat(F.lit("Across the delegation, members have reported "), fmt_money(F.col("raised")), F.lit(" in total receipts, with "), percent(F.col("pac"), F.col("raised")).cast("string"), F.lit("% from PACs and "), percent(F.col("small"), F.col("raised")).cast("string"), F.lit("% from small-dollar individual contributions."))),
        F.when(F.col("positions") > 0, F.concat(F.format_number("positions", 0), F.lit(" individual vote positions have been recorded across the delegation."))),
    ]
    after = F.when(F.col("seats") > 0, F.concat(F.lit("The delegation holds "), num("seats"), F.lit(" committee and subcommittee assignments.")))
    end = F.to_date(F.lit(as_of))
    stats = stats_json(**{name: F.col(c) for name, c in BRIEF_STATS})
    told = b.select("group_id", F.date_sub(end, 7).alias("period_start"), end.alias("period_end"), *BRIEF_MEASURES, stats.alias("stats"), F.concat_ws(" ", *before, F.lit("Committee leadership: ")).alias("head"), F.concat_ws(" ", F.lit("."), after).alias("tail"), F.concat_ws(" ", *before, after).alias("plain"), F.lit(True).alias("first"))
    pieces = told.unionByName(duties.select("group_id", "full_name", "duties", F.lit(False).alias("first")), allowMissingColumns=True)
    n = min(max(1, group_dim.count()), TASKS)
    places = group_dim.select("group_id", ((F.row_number().over(Window.orderBy("group_id")) - 1) % n).alias("place"))  # else two long texts may meet in a task
    ordered = pieces.join(places, "group_id").repartitionById(n, F.col("place")).sortWithinPartitions("group_id", F.desc("first"), "full_name").drop("full_name", "place")
    columns = ["group_id", "period_start", "period_end", *BRIEF_MEASURES, "stats"]
    schema = T.StructType([*(told.schema[c] for c in columns), T.StructField("summary", T.StringType())])
    return ordered.mapInArrow(_written(columns), schema, profile=_alone(entity.sparkSession))
