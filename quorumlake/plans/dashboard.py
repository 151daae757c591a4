"""Queries of pages and ingest jobs: look-ups, boards, totals, labels, repairs. The SQL states its values itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import core, events, people, text, trades
from ..sources import feeds, xml
from .catalog import _RANGE, _topk_sql, query
from .fixtures import Tables


def _text(name: str, function, table: str, keys: str, raw: str, value: str) -> None:
    """A query that gives the rows of ``table`` the function of a text made of their columns; ``raw`` is SQL for Spark, ``value`` the oracle's."""
    query(name, f"SELECT {keys}, CAST({value} AS VARCHAR) AS value FROM {{{table}}}")(lambda t: getattr(t, table).selectExpr(*keys.split(", "), f"{raw} AS _x").select(*keys.split(", "), function(F.col("_x")).cast("string").alias("value")))


_text("map_asset_type", S.map_asset_type, "part", "p_partkey", "CASE p_type WHEN 'MEDIUM' THEN 'Corporate ' || p_name || ' BOND' WHEN 'STANDARD' THEN p_name || ' Common Stock' WHEN 'LARGE' THEN ' ' || p_name || ' ' WHEN 'PROMO' THEN 'Index fund of ' || p_name WHEN 'SMALL' THEN 'Stock Option, ' || p_name WHEN 'ECONOMY' THEN '' END", "CASE p_type WHEN 'MEDIUM' THEN 'Bond' WHEN 'STANDARD' THEN 'Stock' WHEN 'LARGE' THEN p_name WHEN 'PROMO' THEN 'Fund' WHEN 'SMALL' THEN 'Stock' END")
_text("map_tx_type", S.map_tx_type, "events", "event_id", "CASE event_type WHEN 'purchase' THEN event_type WHEN 'click' THEN 'Partial sale no. ' || event_id WHEN 'view' THEN 'Exchange ' || event_id WHEN 'signup' THEN 'Order to BUY ' || event_id ELSE ' Sale (Full) ' || event_type END", "CASE event_type WHEN 'purchase' THEN 'P' WHEN 'click' THEN 'S (partial)' WHEN 'view' THEN 'E' WHEN 'signup' THEN 'P' ELSE 'S' END")
_text("map_owner", S.map_owner, "orders", "o_orderkey", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Spouse of ' || o_custkey WHEN '2-HIGH' THEN 'DEPENDENT of ' || o_custkey WHEN '3-MEDIUM' THEN 'Joint, ' || o_orderpriority WHEN '5-LOW' THEN 'Minor child' ELSE o_orderpriority END", "CASE o_orderpriority WHEN '1-URGENT' THEN 'SP' WHEN '2-HIGH' THEN 'DC' WHEN '3-MEDIUM' THEN 'JT' WHEN '5-LOW' THEN 'DC' END")
_text("norm_position", S.norm_position, "events", "event_id", "CASE event_type WHEN 'click' THEN ' Yea ' WHEN 'signup' THEN 'AYE' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Nay' ELSE ' no' END WHEN 'purchase' THEN 'Present' ELSE event_type END", "CASE event_type WHEN 'click' THEN 'yea' WHEN 'signup' THEN 'yea' WHEN 'view' THEN 'nay' WHEN 'purchase' THEN 'present' ELSE 'not_voting' END")
_text("norm_party", S.norm_party, "customer", "c_custkey", "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Libertarian' WHEN c_acctbal > 0 THEN c_mktsegment END", "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Independent' WHEN c_acctbal > 0 THEN c_mktsegment END")
_text("chamber_from_type", S.chamber_from_type, "entity", "entity_id", "CASE WHEN NOT in_office THEN '' WHEN chamber = 'senate' THEN 'sen' ELSE 'rep' END", "CASE WHEN in_office THEN chamber ELSE 'house' END")
_text("norm_role", S.norm_role, "assignment", "entity_id, committee_id", "CASE role WHEN 'chair' THEN CASE WHEN entity_id % 2 = 0 THEN 'Chair' ELSE 'Chairman' END WHEN 'ranking_member' THEN 'Ranking Member' WHEN 'vice_chair' THEN CASE WHEN entity_id % 2 = 0 THEN 'Vice Chair' ELSE 'Vice Chairman' END ELSE nullif('Clerk of ' || committee_id, 'Clerk of B04') END", "role")
_MESSY = "CASE amount % 6 WHEN 0 THEN 'none stated' WHEN 1 THEN 'OVER $50,000,000' WHEN 2 THEN replace({r}, ' - ', '-') WHEN 3 THEN 'about ' || replace({r}, ' - ', '  -   ') WHEN 4 THEN {r} || ', ' || asset_description ELSE '' END"
_SHOWN = "CASE WHEN amount <= 15000 THEN '$1,001 - $15,000' WHEN amount <= 50000 THEN '$15,001 - $50,000' WHEN amount <= 100000 THEN '$50,001 - $100,000' WHEN amount <= 250000 THEN '$100,001 - $250,000' WHEN amount <= 500000 THEN '$250,001 - $500,000' ELSE '$500,001 - $1,000,000' END"
_text("amount_bucket", lambda x: S.amount_bucket(x)["label"], "trade", "filing_id, row_index", _MESSY.format(r=_SHOWN), f"CASE WHEN amount % 6 IN (0, 5) THEN '$1,001 - $15,000' WHEN amount % 6 = 1 THEN 'Over $50,000,000' ELSE {_SHOWN} END")
_text("amount_bucket_high", lambda x: S.amount_bucket(x)["high"], "trade", "filing_id, row_index", _MESSY.format(r=_SHOWN), "CASE WHEN amount % 6 IN (0, 5) OR amount % 6 <> 1 AND amount <= 15000 THEN 15000 WHEN amount % 6 = 1 THEN NULL WHEN amount <= 50000 THEN 50000 WHEN amount <= 100000 THEN 100000 WHEN amount <= 250000 THEN 250000 WHEN amount <= 500000 THEN 500000 ELSE 1000000 END")
_text("clean_ticker", lambda x: S.clean_ticker(F.lit(None).cast("string"), x), "part", "p_partkey", "p_name || CASE p_type WHEN 'MEDIUM' THEN ' (BA) [ST]' WHEN 'STANDARD' THEN ' (THE) CMN' WHEN 'LARGE' THEN ' [CT]' WHEN 'PROMO' THEN ' (CT) [CT]' WHEN 'SMALL' THEN ' (' || upper(substring(p_name, 1, 3)) || ') ' || p_brand ELSE ' (ABCDEFG) (' || p_name || ')' END", "CASE p_type WHEN 'MEDIUM' THEN 'BA' WHEN 'PROMO' THEN 'CT' WHEN 'SMALL' THEN CASE WHEN left(p_name, 3) NOT IN ('old', 'new') THEN upper(left(p_name, 3)) END END")
_text("valid_ticker", S.valid_ticker, "part", "p_partkey", "CASE p_type WHEN 'PROMO' THEN p_brand WHEN 'LARGE' THEN '9' || upper(substring(p_name, 1, 2)) WHEN 'SMALL' THEN 'BRK.B-1' ELSE upper(replace(p_name, ' ', '')) END", "CASE WHEN p_type IN ('PROMO', 'LARGE') THEN FALSE WHEN p_type = 'SMALL' THEN TRUE ELSE length(replace(p_name, ' ', '')) <= 8 END")
_text("link_item", lambda x: S.item_from_text(x, F.lit(119)), "part", "p_partkey", "CASE p_type WHEN 'MEDIUM' THEN 'H R ' || p_partkey || ' ' || p_name WHEN 'STANDARD' THEN 'S. ' || p_partkey WHEN 'LARGE' THEN 'h.j.res. ' || p_partkey || ', as amended' WHEN 'PROMO' THEN 'HR' || p_partkey ELSE 'On ' || p_name END", "CASE p_type WHEN 'MEDIUM' THEN 'hr-' || p_partkey || '-119' WHEN 'STANDARD' THEN 's-' || p_partkey || '-119' WHEN 'LARGE' THEN 'hjres-' || p_partkey || '-119' WHEN 'PROMO' THEN 'hr-' || p_partkey || '-119' END")
_text("tx_label", S.tx_label, "line", "filing_id, row_index", "CASE WHEN tx_type = 'S' THEN 'E' ELSE tx_type END", "CASE tx_type WHEN 'P' THEN 'Purchase' WHEN 'S' THEN 'Exchange' WHEN 'S (partial)' THEN 'Partial sale' ELSE tx_type END")
_text("role_label", S.role_label, "assignment", "entity_id, committee_id", "role", "CASE role WHEN 'ranking_member' THEN 'ranking member' WHEN 'vice_chair' THEN 'vice chair' ELSE role END")
_text("display_last_name", S.display_last_name, "entity", "entity_id", "CASE WHEN in_office THEN ' Ada  M. ' || full_name || ' ' ELSE full_name END", "full_name")
_text("strip_suffix", S.strip_suffix, "entity", "entity_id", "full_name || CASE party WHEN 'Democrat' THEN ', Jr.' WHEN 'Republican' THEN ', IV' WHEN 'FURNITURE' THEN ' V' WHEN 'HOUSEHOLD' THEN ',  sr' ELSE '' END", "full_name || CASE party WHEN 'FURNITURE' THEN ' V' ELSE '' END")
query("seat_label", "SELECT entity_id, CASE WHEN chamber = 'senate' THEN 'Senator' WHEN district > 0 THEN 'District ' || district ELSE 'At-Large' END AS seat FROM {entity}")(lambda t: t.entity.select("entity_id", S.seat_label(F.col("chamber"), F.col("district")).alias("seat")))
query("mid_amount", "SELECT entity_id, CASE WHEN entity_id % 3 = 0 AND entity_id % 2 = 0 THEN 1000.0 WHEN entity_id % 3 = 0 THEN entity_id + 10.0 WHEN entity_id % 2 = 0 THEN CAST(entity_id AS DOUBLE) ELSE entity_id + 5.0 END AS mid FROM {entity}")(
    lambda t: t.entity.select("entity_id", S.mid_amount(F.when(F.col("entity_id") % 3 != 0, F.col("entity_id")), F.when(F.col("entity_id") % 2 != 0, F.col("entity_id") + 10)).alias("mid"))
)

# ---- look-ups and predicates

query("group_by_code", "SELECT group_id, name FROM {group_dim} WHERE group_id % 2 = 0")(lambda t: people.by_code(t.group_dim, t.group_dim.where("group_id % 2 = 0").select(F.lower("name").alias("code"))).select("group_id", "name"))
query("entity_by_id", "SELECT entity_id, full_name, party FROM {entity} WHERE entity_id IN (SELECT entity_id FROM {position})")(lambda t: t.entity.join(t.position.select("entity_id"), "entity_id", "left_semi").select("entity_id", "full_name", "party"))
query("entity_terms", "SELECT o_custkey AS entity_id, o_orderkey AS term_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders")(lambda t: core.ranked(t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("term_id"), "o_orderdate"), ["entity_id"], [F.desc("o_orderdate"), F.asc("term_id")], "rank").drop("o_orderdate"))
query("partition_by_flag", "SELECT entity_id, chamber = 'senate' AS senator, group_id IN (3, 5, 8) AS territory FROM {entity}")(lambda t: t.entity.select("entity_id", (F.col("chamber") == "senate").alias("senator"), F.col("group_id").isin(3, 5, 8).alias("territory")))
query("pick_titles", "SELECT e.group_id, r.title FROM {release} r JOIN {entity} e USING (entity_id)")(lambda t: t.release.join(t.entity.select("entity_id", "group_id"), "entity_id").select("group_id", "title"))
query("delegation_senators", "SELECT group_id, entity_id FROM {entity} WHERE in_office AND chamber = 'senate'")(lambda t: t.entity.where("in_office AND chamber = 'senate'").select("group_id", "entity_id"))
_GIFT = "(SELECT o_custkey AS entity_id, year(o_orderdate) AS cycle, l_suppkey AS contributor_name, CAST(round(l_extendedprice) AS BIGINT) AS total_amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _gifts(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("cycle"), F.col("l_suppkey").alias("contributor_name"), F.round("l_extendedprice").cast("long").alias("total_amount"))


for _name, _when, _cycle in (("top_contributors", "", None), ("top_contributors_of_cycle", " WHERE cycle = 1998", 1998)):
    query(_name, f"SELECT entity_id, contributor_name, total_amount, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY total_amount DESC, contributor_name) AS rn FROM (SELECT entity_id, contributor_name, sum(total_amount)::BIGINT AS total_amount FROM {_GIFT} g{_when} GROUP BY 1, 2) s) x WHERE rn <= 10")(lambda t, c=_cycle: people.top_contributors(_gifts(t), c))

# ---- ingest

query("split_new_existing", "SELECT filing_id, 'existing' AS branch FROM {filing} WHERE filing_id % 3 = 0 UNION ALL (SELECT filing_id, 'new' FROM {filing} WHERE filing_id % 3 <> 0 ORDER BY filed_date DESC, filing_id LIMIT 2000)")(
    lambda t: _tagged(core.split_new_existing(t.filing, t.filing.where("filing_id % 3 = 0"), ["filing_id"], [F.desc("filed_date"), F.asc("filing_id")], 2000))
)
query("skip_ingested", "SELECT filing_id FROM {filing} f JOIN {entity} e USING (entity_id) WHERE NOT (e.chamber = 'house' AND filing_id % 5 = 0)")(lambda t: _skip(t))
query("orphan_files", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 11 = 0")(lambda t: core.only_new(t.orders.select(F.col("o_orderkey").alias("doc_id")), t.filing.where("filing_id % 11 <> 0").select(F.col("filing_id").alias("doc_id")), ["doc_id"]))
query("ingest_finance", "SELECT entity_id, cycle, CAST(floor(coalesce(r, 0) + 0.5) AS BIGINT) AS receipts, CAST(floor(d + 0.5) AS BIGINT) AS spent FROM (SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS cycle, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS r, o_totalprice / 2 AS d FROM orders) x WHERE cycle IS NOT NULL")(
    lambda t: feeds.ingest_finance(t.orders.select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("cycle"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("receipts"), (F.col("o_totalprice") / 2).alias("spent")), ["receipts", "spent"]).select("entity_id", F.col("cycle").cast("long").alias("cycle"), "receipts", "spent")
)
query("join_social", "SELECT e.entity_id, s.handle FROM {entity} e LEFT JOIN (SELECT o_custkey AS entity_id, arg_max('@' || o_orderkey, o_orderkey) AS handle FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) s USING (entity_id)")(
    lambda t: feeds.join_social(t.entity.select("entity_id"), t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("@"), F.col("o_orderkey").cast("string")).alias("handle"), "o_orderkey"), [F.desc("o_orderkey")]).select("entity_id", "handle")
)
query("split_valid", "SELECT filing_id, row_index, tx_type IN ('P', 'S', 'S (partial)', 'E') AND amount_range <> '?' AND length(trim(asset_description)) >= 2 AS valid FROM {line}")(lambda t: _split(t))
query("senate_rollcall_round_trip", "SELECT CAST(p.ballot_id AS VARCHAR) AS ballot_id, k.entity_id, p.position FROM {position} p JOIN {person} e ON e.entity_id = p.entity_id JOIN (SELECT lower(last_name) AS last, state, max(entity_id) AS entity_id FROM {person} GROUP BY 1, 2) k ON k.last = lower(e.last_name) AND k.state = e.state")(lambda t: _senate(t)[1])
query("senate_rollcall_headers", "SELECT CAST(ballot_id AS VARCHAR) AS ballot_id, CASE WHEN nays % 2 = 0 THEN ballot_date ELSE make_date(year(ballot_date), 1, 1) END AS ballot_date, 'On the Motion' AS question, yeas::INTEGER AS yeas, nays::INTEGER AS nays FROM {ballot}")(lambda t: _senate(t)[0])


def _tagged(parts) -> DataFrame:
    known, new = parts
    return known.select("filing_id", F.lit("existing").alias("branch")).union(new.select("filing_id", F.lit("new")))


def _skip(t: Tables) -> DataFrame:
    docs = t.filing.join(t.entity.select("entity_id", "chamber"), "entity_id").select("filing_id", "chamber")
    return core.only_new(docs, docs.where("chamber = 'house' AND filing_id % 5 = 0"), ["chamber", "filing_id"]).select("filing_id")


def _split(t: Tables) -> DataFrame:
    valid, rejected = core.split_valid(t.line, trades.line_errors())
    return valid.select("filing_id", "row_index", F.lit(True).alias("valid")).union(rejected.select("filing_id", "row_index", F.lit(False)))


def _senate(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Roll calls by name and state, at most 50 members a document; every second date cannot be read."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    who = t.position.join(t.person.select("entity_id", "last_name", "state"), "entity_id")
    member = tag("member", F.concat(tag("last_name", F.col("last_name")), tag("party", F.lit("I")), tag("state", F.col("state")), tag("vote_cast", F.initcap("position"))))
    date = F.when(F.col("nays") % 2 == 0, F.date_format("ballot_date", "MMMM d, yyyy,  hh:mm a")).otherwise("soon")
    key = [F.year("ballot_id").alias("year"), F.unix_timestamp("ballot_id").alias("roll")]
    top = F.concat(tag("vote_date", date), tag("question", F.lit("On the Motion")), tag("count", F.concat(tag("yeas", F.col("yeas").cast("string")), tag("nays", F.col("nays").cast("string")))))
    heads = t.ballot.select(*key, tag("roll_call_vote", top).alias("xml"))
    dealt = who.select(*key, member.alias("m"), F.pmod(F.xxhash64("entity_id"), F.lit(64)).alias("part")).groupBy("year", "roll", "part").agg(F.array_join(F.collect_list("m"), "").alias("m"))
    parts = dealt.select("year", "roll", tag("roll_call_vote", tag("members", F.col("m"))).alias("xml"))
    ballot = F.timestamp_seconds(F.substring_index("vote_id", "-", -1).cast("long")).cast("string").alias("ballot_id")
    head, _, _ = xml.senate_rolls(heads, t.person, [F.desc("entity_id")], 119)
    _, positions, _ = xml.senate_rolls(parts, t.person, [F.desc("entity_id")], 119)
    return head.select(ballot, "ballot_date", "question", "yeas", "nays"), positions.select(ballot, "entity_id", "position")


# ---- boards

query("group_activity", _topk_sql("group_id, event_type, related_id, entity_id, title, event_date, rn::INTEGER AS rank", """(
  SELECT group_id, 'bill_introduced' AS event_type, item_id::VARCHAR AS related_id, entity_id, title, introduced_date AS event_date FROM (
    SELECT e.entity_id, e.group_id, i.item_id, e.full_name || ' introduced ' || upper(i.item_type) || ' ' || i.item_id AS title, i.introduced_date
    FROM {item_link} l JOIN {item} i USING (item_id) JOIN {entity} e ON e.entity_id = l.entity_id WHERE l.role = 'sponsor' AND i.introduced_date IS NOT NULL ORDER BY i.introduced_date DESC, i.item_id, e.entity_id LIMIT 500) x
  UNION ALL SELECT group_id, 'vote_cast', strftime(ballot_id, '%Y-%m-%d %H'), NULL,
    CASE WHEN yea = total THEN 'House vote: delegation voted unanimously Yea on ' WHEN nay = total THEN 'House vote: delegation voted unanimously Nay on ' ELSE 'House vote: ' || yea || ' Yea, ' || nay || ' Nay on ' END || 'ballot ' || strftime(ballot_id, '%Y-%m-%d %H'), ballot_date FROM (
    SELECT b.ballot_id, b.ballot_date, e.group_id, count(*) FILTER (p.position = 'yea') AS yea, count(*) FILTER (p.position = 'nay') AS nay, count(*) AS total
    FROM {position} p JOIN (SELECT * FROM {ballot} ORDER BY ballot_date DESC, ballot_id DESC LIMIT 100) b USING (ballot_id) JOIN {entity} e ON e.entity_id = p.entity_id GROUP BY 1, 2, 3) y)""", "group_id", "event_date DESC, event_type, related_id, entity_id", 15))(lambda t: _activity(t))


def _activity(t: Tables) -> DataFrame:
    items = events.item_events(t.item_link, t.item, t.entity)
    label = F.date_format("ballot_id", "yyyy-MM-dd HH")
    ballots = t.ballot.select("ballot_id", "ballot_date", label.alias("related_id"), F.lit("house").alias("chamber"), F.concat(F.lit("ballot "), label).alias("subject"))
    return events.group_activity(items.unionByName(events.ballot_events(ballots, t.position, t.entity)))


query("party_role_board", "SELECT e.group_id, e.entity_id, e.chamber, f.total, row_number() OVER (PARTITION BY e.group_id ORDER BY f.total DESC NULLS LAST, e.entity_id)::INTEGER AS rank FROM {entity} e LEFT JOIN (SELECT entity_id, CASE WHEN total_receipts > 0 THEN total_receipts ELSE greatest(total_individual, small_individual) + total_pac END AS total FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY cycle DESC) AS rn FROM {finance_cycle}) x WHERE rn = 1) f USING (entity_id) WHERE e.in_office")(
    lambda t: people.finance_board(t.entity, people.latest_finance(t.finance_cycle))
)
query("trades_totals", "SELECT m.*, f.* FROM (SELECT count(DISTINCT entity_id) AS members, count(*) AS trades, count(*) FILTER (filed_late) AS late, min(tx_date) AS first_date, max(tx_date) AS last_date FROM {trade}) m, (SELECT count(*) AS filings, max(filed_date) AS latest_filing FROM {filing}) f")(lambda t: trades.totals(t.trade, t.filing))
query("member_trades", "SELECT ticker, entity_id, row_number() OVER (PARTITION BY ticker, entity_id ORDER BY tx_date NULLS FIRST, filing_id, row_index)::INTEGER AS seq, tx_date, tx_type, filing_id, row_index FROM {trade} WHERE ticker IS NOT NULL")(lambda t: trades.member_trades(t.trade))
query("ticker_trades", "SELECT t.ticker, e.full_name, t.filing_id, t.row_index, t.tx_date, f.parse_status FROM {trade} t JOIN {entity} e USING (entity_id) JOIN {filing} f ON f.filing_id = t.filing_id WHERE t.ticker IS NOT NULL")(lambda t: t.trade.where("ticker IS NOT NULL").join(t.entity.select("entity_id", "full_name"), "entity_id").join(t.filing.select("filing_id", "parse_status"), "filing_id").select("ticker", "full_name", "filing_id", "row_index", "tx_date", "parse_status"))
_LOW = "CASE WHEN amount <= 15000 THEN 1001 WHEN amount <= 50000 THEN 15001 WHEN amount <= 100000 THEN 50001 WHEN amount <= 250000 THEN 100001 WHEN amount <= 500000 THEN 250001 ELSE 500001 END"
_HIGH = "CASE WHEN amount <= 15000 THEN 15000 WHEN amount <= 50000 THEN 50000 WHEN amount <= 100000 THEN 100000 WHEN amount <= 250000 THEN 250000 WHEN amount <= 500000 THEN 500000 ELSE 1000000 END"
query("trade_summary", f"SELECT f.entity_id, coalesce(trades, 0) AS trades, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells, coalesce(late, 0) AS late, coalesce(low, 0)::BIGINT AS low, coalesce(high, 0)::BIGINT AS high, first_date, last_date, f.filings FROM (SELECT entity_id, count(*) AS filings FROM {{filing}} GROUP BY 1) f LEFT JOIN (SELECT entity_id, count(*) AS trades, count(*) FILTER (tx_type = 'P') AS buys, count(*) FILTER (tx_type LIKE 'S%') AS sells, count(*) FILTER (filed_late) AS late, sum({_LOW}) AS low, sum({_HIGH}) AS high, min(tx_date) AS first_date, max(tx_date) AS last_date FROM {{trade}} GROUP BY 1) l USING (entity_id)")(
    lambda t: trades.trade_summary(t.trade, t.filing)  # filings of ids below 0 have no lines
)
query("trades_home_totals", "SELECT l.*, (SELECT count(*) FROM {filing}) AS filings FROM (SELECT count(*) AS trades, count(DISTINCT entity_id) FILTER (chamber = 'senate') AS senate, count(DISTINCT entity_id) FILTER (chamber = 'house') AS house FROM {trade} JOIN {entity} USING (entity_id)) l")(lambda t: trades.home_totals(t.trade, t.entity, t.filing))
query("freshness_label", "SELECT source, entity_type, CASE WHEN h < 1 THEN '< 1 hour ago' WHEN h < 24 THEN h || 'h ago' ELSE (h // 24) || 'd ago' END AS label, h < 48 AS fresh FROM (SELECT source, entity_type, floor(date_diff('second', date_trunc('second', max(completed_at)), TIMESTAMP '2024-01-31 00:00:00') / 3600)::BIGINT AS h FROM {run_log} WHERE status = 'success' AND records_count > 0 GROUP BY 1, 2) x")(lambda t: _fresh(t))
query("stats_json", """SELECT group_id, '{"members":' || count(*) || ',"senators":' || count(*) FILTER (chamber = 'senate') || ',"top":' || CASE WHEN max(entity_id) % 2 = 0 THEN 'null' ELSE max(entity_id)::VARCHAR END || '}' AS stats FROM {entity} GROUP BY 1""")(
    lambda t: t.entity.groupBy("group_id").agg(F.count("*").alias("m"), F.count_if(F.col("chamber") == "senate").alias("s"), F.max("entity_id").alias("x")).select("group_id", S.stats_json(members=F.col("m"), senators=F.col("s"), top=F.when(F.col("x") % 2 != 0, F.col("x"))).alias("stats"))
)
query("latest_brief", "SELECT entity_type AS group_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY completed_at DESC, run_id DESC) AS rn FROM {run_log}) x WHERE rn = 1")(lambda t: core.latest_per_key(t.run_log, ["entity_type"], [F.desc("completed_at"), F.desc("run_id")]).select(F.col("entity_type").alias("group_id"), "run_id"))


def _fresh(t: Tables) -> DataFrame:
    last = t.run_log.where("status = 'success' AND records_count > 0").groupBy("source", "entity_type").agg(F.date_trunc("second", F.max("completed_at")).alias("at"))
    hours: Column = F.floor((F.unix_timestamp(F.lit("2024-01-31 00:00:00")) - F.unix_timestamp("at")) / 3600)
    return last.withColumn("h", hours).select("source", "entity_type", S.age_label(F.col("h")).alias("label"), (F.col("h") < 48).alias("fresh"))


# ---- repairs

_REVIEWED = "(SELECT t.*, confidence < 85 AS needs_review, CASE row_index % 4 WHEN 0 THEN 'Bond' WHEN 1 THEN 'Option' WHEN 2 THEN 'Stock' END AS asset_type, CASE WHEN amount % 17 = 0 THEN NULL ELSE " + _RANGE + " END AS amount_range FROM {trade} t)"


def _reviewed(t: Tables) -> DataFrame:
    kind = F.when(F.col("row_index") % 4 == 0, "Bond").when(F.col("row_index") % 4 == 1, "Option").when(F.col("row_index") % 4 == 2, "Stock")
    return trades.bucketed(t.trade).withColumns({"needs_review": F.col("confidence") < 85, "asset_type": kind, "amount_range": F.when(F.col("amount") % 17 != 0, F.col("label"))})


_OK = "ticker IS NULL AND confidence < 80 AND asset_type IN ('Bond', 'Other', 'Option') AND tx_date IS NOT NULL AND amount_range IS NOT NULL AND tx_type IN ('P', 'S', 'S (partial)', 'E') AND length(asset_description) > 5"
query("repair_tickerless", f"SELECT filing_id, row_index, CASE WHEN {_OK} THEN 80 ELSE confidence END AS confidence, CASE WHEN {_OK} THEN FALSE ELSE needs_review END AS needs_review FROM {_REVIEWED} x")(lambda t: trades.repair_tickerless(_reviewed(t)).select("filing_id", "row_index", "confidence", "needs_review"))
query("update_from_aggregate", "SELECT f.filing_id, f.parse_status, coalesce(c.parse_confidence, CAST(f.filing_id % 100 AS INTEGER)) AS parse_confidence FROM {filing} f LEFT JOIN (SELECT filing_id, CAST(round(avg(confidence)) AS INTEGER) AS parse_confidence FROM {trade} GROUP BY 1) c USING (filing_id)")(
    lambda t: trades.header_confidence(t.filing.withColumn("parse_confidence", F.col("filing_id") % 100), t.trade).select("filing_id", "parse_status", "parse_confidence")
)
_FOUND = "(SELECT p_name AS asset_description, CASE max(p_partkey) % 4 WHEN 0 THEN 'FUND' WHEN 1 THEN 'bad' ELSE 'T' || max(p_partkey) % 50 END AS ticker FROM part GROUP BY 1)"
_TAKES = "t.ticker IS NULL AND d.ticker NOT IN ('FUND', 'bad')"
query("enrich_lookup", f"SELECT t.filing_id, t.row_index, CASE WHEN {_TAKES} THEN d.ticker ELSE t.ticker END AS ticker, CASE WHEN {_TAKES} THEN greatest(t.confidence, 85) ELSE t.confidence END AS confidence, CASE WHEN {_TAKES} AND t.confidence < 80 THEN FALSE ELSE t.needs_review END AS needs_review FROM {_REVIEWED} t LEFT JOIN {_FOUND} d USING (asset_description)")(lambda t: _enriched(t))
query("clear_blacklisted", "SELECT filing_id, row_index, CASE WHEN row_index % 3 = 0 THEN NULL ELSE ticker END AS ticker FROM {trade}")(lambda t: trades.clear_blacklisted(t.trade.withColumn("ticker", F.when(F.col("row_index") % 3 == 0, F.when(F.col("row_index") % 2 == 0, "ETF").otherwise("THE")).otherwise(F.col("ticker")))).select("filing_id", "row_index", "ticker"))
query("suspicious_text", "SELECT filing_id, row_index FROM (SELECT *, CASE row_index % 5 WHEN 0 THEN '123456789 12345' WHEN 1 THEN 'short' ELSE 'a longer description' END AS d, CASE row_index % 7 WHEN 0 THEN 'A/B' WHEN 1 THEN NULL ELSE 'AB' END AS k FROM {trade}) x WHERE length(d) < 12 OR row_index % 5 = 0 OR k = 'A/B'")(lambda t: _suspicious(t))
query("line_confidence_stats", "SELECT count(*) AS total, count(*) FILTER (confidence >= 80) AS high, count(*) FILTER (confidence < 80) AS low, count(ticker) AS with_ticker, CAST(round(100.0 * count(*) FILTER (confidence >= 80) / count(*)) AS BIGINT) AS pct, CAST(floor(10.0 * sum(confidence) / count(*) + 0.5) AS BIGINT) AS mean_tenths FROM {trade}")(
    lambda t: t.trade.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 80).alias("high"), F.count_if(F.col("confidence") < 80).alias("low"), F.count("ticker").alias("with_ticker"), F.sum("confidence").alias("s")).select("total", "high", "low", "with_ticker", S.percent(F.col("high"), F.col("total")).alias("pct"), F.floor(10.0 * F.col("s") / F.col("total") + 0.5).alias("mean_tenths"))
)


def _enriched(t: Tables) -> DataFrame:
    code = F.max("p_partkey") % 4
    found = t.part.groupBy(F.col("p_name").alias("asset_description")).agg(F.when(code == 0, "FUND").when(code == 1, "bad").otherwise(F.concat(F.lit("T"), (F.max("p_partkey") % 50).cast("string"))).alias("ticker"))
    return trades.enrich_tickers(_reviewed(t), found).select("filing_id", "row_index", "ticker", "confidence", "needs_review")


def _suspicious(t: Tables) -> DataFrame:
    at = F.col("row_index")
    made = t.trade.withColumns({"asset_description": F.when(at % 5 == 0, "123456789 12345").when(at % 5 == 1, "short").otherwise("a longer description"), "ticker": F.when(at % 7 == 0, "A/B").when(at % 7 != 1, "AB")})
    return trades.suspicious(made).select("filing_id", "row_index")


_PHRASE = "SELECT source, term, n, rn::INTEGER AS rank FROM (SELECT source, 'ate' AS term, count(*) AS n, 1 AS rn FROM {release} WHERE contains(lower(title), 'ate') GROUP BY 1) x"
query("keyword_phrases", _PHRASE)(lambda t: text.keywords(t.release, "source", k=1 << 30, phrases=["ate"]).where("is_phrase").select("source", "term", "n", F.lit(1).alias("rank")))
