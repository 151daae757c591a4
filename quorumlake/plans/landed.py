"""Queries of landed documents and folders: roll calls, rejects, file listings, incremental scans, rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import core, rules, trades
from ..sources import feeds, landing, xml
from .catalog import _RANGE, query
from .fixtures import Tables


def _tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


# ---- roll calls

_ROLL = "(SELECT year(ballot_id) AS year, CAST(epoch(ballot_id) // 3600 AS BIGINT) AS roll, CAST(ballot_id AS DATE) AS day, count(*) FILTER (position = 'yea') AS yeas, count(*) FILTER (position = 'nay') AS nays, count(*) FILTER (position = 'present') AS present, count(*) FILTER (position = 'not_voting') AS not_voting FROM {position} GROUP BY ballot_id)"


def _rolls(t: Tables) -> DataFrame:
    is_ = lambda p: F.count_if(F.col("position") == p).alias({"yea": "yeas", "nay": "nays"}.get(p, p))
    sums = t.position.groupBy("ballot_id").agg(*map(is_, ("yea", "nay", "present", "not_voting")))
    return sums.select(F.year("ballot_id").alias("year"), F.floor(F.unix_timestamp("ballot_id") / 3600).alias("roll"), F.to_date("ballot_id").alias("day"), "yeas", "nays", "present", "not_voting")


def _house(t: Tables) -> DataFrame:
    """House documents: every third without a date, every tenth a quorum call, party totals before those by vote, every seventh cut short."""
    roll, text = F.col("roll"), lambda c: F.col(c).cast("string")
    legis = F.when(roll % 4 == 0, F.concat(F.lit("H R "), text("roll"))).when(roll % 4 == 1, F.concat(F.lit("S "), text("roll"))).when(roll % 4 == 2, F.concat(F.lit("H J RES "), text("roll"))).otherwise("QUORUM")
    totals = F.concat(_tag("totals-by-party", F.lit("<yea-total>99999</yea-total>")), _tag("totals-by-vote", F.concat(*(_tag(f"{k}-total", text(c)) for k, c in (("yea", "yeas"), ("nay", "nays"), ("present", "present"), ("not-voting", "not_voting"))))))
    meta = F.concat(
        _tag("legis-num", legis), _tag("vote-question", F.when(roll % 10 == 0, "Call by States").otherwise("On Passage &amp; More")), _tag("vote-desc", F.concat(F.lit("No. "), text("roll"))),
        _tag("vote-result", F.when(F.col("yeas") > F.col("nays"), "Passed").otherwise("Failed")), _tag("action-date", F.when(roll % 3 == 0, "soon").otherwise(F.date_format("day", "d-MMM-yyyy"))), F.when(roll % 10 == 0, "").otherwise(_tag("vote-totals", totals)),
    )
    whole = F.concat(F.lit("<?xml version='1.0'?>"), _tag("rollcall-vote", _tag("vote-metadata", meta)))
    return _rolls(t).select("year", "roll", F.when(roll % 7 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("xml"))


query("house_rollcall_headers", """SELECT 'house-119-' || year || '-' || roll AS vote_id, CASE WHEN roll % 3 = 0 THEN make_date(year, 1, 1) ELSE day END AS ballot_date, 'On Passage & More' AS question, 'No. ' || roll AS description,
  CASE WHEN yeas > nays THEN 'Passed' ELSE 'Failed' END AS result, CASE roll % 4 WHEN 0 THEN 'hr-' || roll || '-119' WHEN 1 THEN 's-' || roll || '-119' WHEN 2 THEN 'hjres-' || roll || '-119' END AS item_id,
  yeas::INTEGER AS yeas, nays::INTEGER AS nays, present::INTEGER AS present, not_voting::INTEGER AS not_voting FROM """ + _ROLL + " r WHERE roll % 10 <> 0 AND roll % 7 <> 0")(lambda t: xml.house_rolls(_house(t), 119)[0])
query("house_rollcall_rejects", "SELECT year, roll FROM " + _ROLL + " r WHERE roll % 7 = 0")(lambda t: xml.house_rolls(_house(t), 119)[2].select(F.col("year").cast("long").alias("year"), "roll"))


def _senate(t: Tables) -> DataFrame:
    """Senate documents: every fourth without a document number, every fifth with an unreadable date."""
    roll, text = F.col("roll"), lambda c: F.col(c).cast("string")
    parts = [
        _tag("vote_date", F.when(roll % 5 == 0, "n/a").otherwise(F.date_format("day", "MMMM d, yyyy,  hh:mm a"))), _tag("question", F.lit("On the Nomination")), _tag("vote_title", F.when(roll % 2 == 0, F.concat(F.lit("Title "), text("roll"))).otherwise("")), _tag("vote_result", F.lit("Confirmed")),
        _tag("document", F.concat(_tag("document_type", F.when(roll % 3 == 0, "H.R.").when(roll % 3 == 1, "S. J. Res.").otherwise("PN")), _tag("document_number", F.when(roll % 4 == 0, "").otherwise(text("roll"))))),
        _tag("count", F.concat(_tag("yeas", text("yeas")), _tag("nays", text("nays")))),
    ]
    return _rolls(t).select("year", "roll", _tag("roll_call_vote", F.concat(*parts)).alias("xml"))


query("senate_rollcall_documents", """SELECT 'senate-119-' || year || '-' || roll AS vote_id, CASE WHEN roll % 5 = 0 THEN make_date(year, 1, 1) ELSE day END AS ballot_date, 'On the Nomination' AS question, CASE WHEN roll % 2 = 0 THEN 'Title ' || roll END AS description,
  'Confirmed' AS result, CASE WHEN roll % 4 <> 0 THEN CASE roll % 3 WHEN 0 THEN 'hr-' WHEN 1 THEN 'sjres-' ELSE 'pn-' END || roll || '-119' END AS item_id, yeas::INTEGER AS yeas, nays::INTEGER AS nays FROM """ + _ROLL + " r")(
    lambda t: xml.senate_rolls(_senate(t), t.person, [F.desc("entity_id")], 119)[0]
)

# ---- persons and trades

_PERSON = "(SELECT e.*, entity_id % 3 AS k FROM {entity} e)"
query("normalize_entities", """SELECT 'E' || entity_id AS entity_id, CASE WHEN k = 0 THEN full_name ELSE 'Ann ' || full_name END AS full_name, 'Ann' AS first_name, full_name AS last_name, CASE WHEN k = 1 THEN 'Independent' ELSE party END AS party, group_id::VARCHAR AS state, chamber, district::INTEGER AS district,
  CASE WHEN k <> 2 THEN DATE '1950-01-01' + CAST(entity_id AS INTEGER) END AS birth_date, CASE WHEN k = 0 THEN 'F' END AS gender, CASE WHEN k = 1 THEN 'https://x/' || entity_id END AS website_url, NULL AS contact_form, '202-' || entity_id AS phone, CASE WHEN k = 2 THEN 'F' || entity_id END AS fec_id FROM """ + _PERSON + " p WHERE entity_id % 8 <> 0 AND entity_id % 11 <> 0")(lambda t: feeds.normalize_entities(landing.parse_json(_persons(t), feeds.PERSON)[0]))
query("rejected_records", "SELECT CASE WHEN entity_id % 16 = 0 THEN NULL ELSE '{\"id\":{\"bioguide\":\"E' || entity_id || '\"' END AS record FROM {entity} WHERE entity_id % 8 = 0")(lambda t: landing.parse_json(_persons(t), feeds.PERSON)[1])


def _persons(t: Tables) -> DataFrame:
    """Entities as nested person records; every eighth is broken or null, every eleventh has no term."""
    k, name = F.col("entity_id") % 3, F.col("entity_id").cast("string")
    old = F.struct(F.lit("rep").alias("type"), F.lit("XX").alias("state"), F.lit(99).alias("district"), F.lit("Old").alias("party"), F.lit("https://old").alias("url"), F.lit("").alias("phone"))
    new = F.struct(F.when(F.col("chamber") == "senate", "sen").otherwise("rep").alias("type"), F.col("group_id").cast("string").alias("state"), F.col("district").cast("int").alias("district"), F.when(k == 1, "Libertarian").otherwise(F.col("party")).alias("party"), F.when(k == 1, F.concat(F.lit("https://x/"), name)).otherwise("").alias("url"), F.concat(F.lit("202-"), name).alias("phone"))
    bio = F.struct(F.when(k != 2, F.date_add(F.lit("1950-01-01").cast("date"), F.col("entity_id").cast("int")).cast("string")).otherwise("").alias("birthday"), F.when(k == 0, "F").alias("gender"))
    ids = F.struct(F.concat(F.lit("E"), name).alias("bioguide"), F.when(k == 2, F.array(F.concat(F.lit("F"), name), F.lit("second"))).alias("fec"))
    full = F.struct(F.lit("Ann").alias("first"), F.col("full_name").alias("last"), F.when(k == 0, F.col("full_name")).when(k == 1, "").alias("official_full"))
    whole = F.to_json(F.struct(ids.alias("id"), full.alias("name"), bio.alias("bio"), F.when(F.col("entity_id") % 11 == 0, F.array().cast("array<struct<type: string, state: string, district: int, party: string, url: string, phone: string>>")).otherwise(F.array(old, new)).alias("terms")))
    broken = F.when(F.col("entity_id") % 16 != 0, F.concat(F.lit('{"id":{"bioguide":"E'), name, F.lit('"')))
    return t.entity.select(F.when(F.col("entity_id") % 8 == 0, broken).otherwise(whole).alias("json"))


_ODD = "CASE amount % 5 WHEN 0 THEN 'none stated' WHEN 1 THEN upper('over $50,000,000') WHEN 2 THEN replace({r}, ' - ', '-') WHEN 3 THEN 'about ' || replace({r}, ' - ', '   -  ') ELSE {r} END"
query("html_trade_amounts", "SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY row_index)::INTEGER - 1 AS row_index, ticker, CASE WHEN amount % 5 = 0 THEN '$1,001 - $15,000' WHEN amount % 5 = 1 THEN 'Over $50,000,000' ELSE " + _RANGE + " END AS amount_range, CASE WHEN amount % 5 = 0 THEN 1001 WHEN amount % 5 = 1 THEN 50000001 WHEN amount <= 15000 THEN 1001 WHEN amount <= 50000 THEN 15001 WHEN amount <= 100000 THEN 50001 WHEN amount <= 250000 THEN 100001 WHEN amount <= 500000 THEN 250001 ELSE 500001 END::BIGINT AS amount_min, CASE WHEN amount % 5 = 0 THEN 15000 WHEN amount % 5 = 1 THEN NULL WHEN amount <= 15000 THEN 15000 WHEN amount <= 50000 THEN 50000 WHEN amount <= 100000 THEN 100000 WHEN amount <= 250000 THEN 250000 WHEN amount <= 500000 THEN 500000 ELSE 1000000 END::BIGINT AS amount_max, amount % 2 = 0 AS cap_gains, CASE WHEN ticker IS NULL THEN 85 ELSE 95 END AS confidence FROM {trade} WHERE row_index % 6 <> 0")(lambda t: _amounts(t))


def _amounts(t: Tables) -> DataFrame:
    """A page a filing with odd amount cells; rows without a description are no lines."""
    label, odd = F.col("label"), F.col("amount") % 5
    amount = F.when(odd == 0, "none stated").when(odd == 1, "OVER $50,000,000").when(odd == 2, F.replace(label, F.lit(" - "), F.lit("-"))).when(odd == 3, F.concat(F.lit("about "), F.replace(label, F.lit(" - "), F.lit("   -  ")))).otherwise(label)
    cells = [F.col("row_index").cast("string"), F.lit("1/2/2024"), F.lit("Self"), F.coalesce("ticker", F.lit("--")), F.when(F.col("row_index") % 6 == 0, " ").otherwise(F.lit("asset")), F.lit("Stock"), F.lit("Purchase"), amount, F.when(F.col("amount") % 2 == 0, "Capital Gains over $200").otherwise("")]
    row = _tag("tr", F.concat(*(_tag("td", c) for c in cells)))
    head = "<table class='wide'><tr><td>x</td></tr></table><table class=\"table\"><thead><tr><th>#</th></tr></thead>"
    pages = trades.bucketed(t.trade).select("filing_id", F.struct("row_index", row.alias("row")).alias("r")).groupBy("filing_id").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("r"))["row"], ""), F.lit("</table>")).alias("html"))  # a filing's lines, seven at most here
    return feeds.parse_html_trades(pages, "filing_id").select("filing_id", "row_index", "ticker", "amount_range", "amount_min", "amount_max", "cap_gains", "confidence")


# ---- folders

query("changed_events", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(completed_at) FILTER (status = 'success' AND records_count > 0) - INTERVAL 1 DAY FROM {run_log} WHERE source = 'purchase')")(lambda t: _changed(t))


def _changed(t: Tables) -> DataFrame:
    """Events landed in a folder a day; only the days since the last purchase run are read."""
    spark, path = t.events.sparkSession, landing.folder(t.events.sparkSession)
    t.events.select("event_id", "ts", F.to_date("ts").alias("day")).repartition("day").write.partitionBy("day").parquet(path)
    return landing.changed_since(spark.read.parquet(path), t.run_log, "purchase", "day", "ts").select("event_id", "ts")


query("orphan_folders", "SELECT strftime(date_trunc('week', CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS week, count(*) AS n FROM orders WHERE date_trunc('week', CAST(o_orderdate AS DATE)) NOT IN (SELECT date_trunc('week', filed_date) FROM {filing} WHERE parse_status = 'review') GROUP BY 1")(lambda t: _orphans(t))


def _orphans(t: Tables) -> DataFrame:
    """Orders landed in a file a week, listed, less the weeks with a filing under review; then counted in the files that are left."""
    spark, path = t.orders.sparkSession, landing.folder(t.orders.sparkSession)
    week = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd").alias("week")
    t.orders.select(week("o_orderdate"), F.col("o_orderkey").cast("string").alias("value")).repartition("week").write.partitionBy("week").text(path)
    left = landing.orphan_files(landing.listing(spark, path, "*.txt"), t.filing.where("parse_status = 'review'").select(week("filed_date")), "week", r"week=(\d{4}-\d{2}-\d{2})/")
    lines = spark.read.text(path).select(F.col("week").cast("string").alias("week"))
    return lines.join(left.select("week").distinct(), "week", "left_semi").groupBy("week").agg(F.count("*").alias("n"))


_ERRORS = "[x for x in [CASE WHEN tx_type NOT IN ('P', 'S', 'S (partial)', 'E') THEN 'invalid type' END, CASE WHEN amount_range = '?' THEN 'invalid amount range' END] if x IS NOT NULL]"
query("split_rejects", f"SELECT filing_id, row_index, coalesce(array_to_string({_ERRORS}, '; '), '') AS errors, rows, valid FROM {{line}}, (SELECT count(*) AS rows, count(*) FILTER (len({_ERRORS}) = 0) AS valid FROM {{line}}) s")(lambda t: _rejects(t))


def _rejects(t: Tables) -> DataFrame:
    """Both halves of the parsed lines, with the counts that were observed while they were written."""
    valid, rejected, seen = landing.split_rejects(t.line, trades.line_errors(), landing.folder(t.line.sparkSession))
    keys = ["filing_id", "row_index"]
    both = valid.select(*keys, F.lit("").alias("errors")).union(rejected.select(*keys, F.array_join("errors", "; ")))
    return both.select("*", F.lit(seen["rows"]).alias("rows"), F.lit(seen["valid"]).alias("valid"))


# ---- rules

_TEXT = "filing_id::VARCHAR || '/' || row_index"
query("schema_rules", f"""SELECT 'dated' AS rule, {_TEXT} AS key, 1::BIGINT AS n FROM {{line}} WHERE tx_date IS NULL
  UNION ALL SELECT 'type', {_TEXT}, 1 FROM {{line}} WHERE tx_type NOT IN ('P', 'S', 'S (partial)', 'E')
  UNION ALL SELECT 'ticker length', {_TEXT}, 1 FROM {{line}} WHERE length(ticker) > 2
  UNION ALL SELECT 'confidence', {_TEXT}, 1 FROM {{line}} WHERE confidence NOT BETWEEN 0.65 AND 0.95
  UNION ALL SELECT 'one line a day', filing_id::VARCHAR || '/' || tx_date, count(*) FROM {{line}} WHERE tx_date IS NOT NULL GROUP BY filing_id, tx_date HAVING count(*) > 1
  UNION ALL SELECT 'member in office', {_TEXT}, 1 FROM {{line}} WHERE entity_id NOT IN (SELECT entity_id FROM {{person}})""")(lambda t: _rules(t))


def _rules(t: Tables) -> DataFrame:
    table = [
        rules.Rule("dated", "required", ("tx_date",)), rules.Rule("type", "accepted", ("tx_type",), values=("P", "S", "S (partial)", "E")), rules.Rule("ticker length", "longest", ("ticker",), size=2), rules.Rule("confidence", "between", ("confidence",), low=0.65, high=0.95),
        rules.Rule("one line a day", "unique", ("filing_id", "tx_date")), rules.Rule("member in office", "key", ("entity_id",), parent=t.person),
    ]
    return rules.check(t.line, table, ["filing_id", "row_index"])


query("predicate_forms", """SELECT filing_id, row_index, asset_description ILIKE '%EX%' AS like_any_case, ticker IS NULL AS is_null, tx_type IN ('S', 'S (partial)') AS in_list, amount BETWEEN 15001 AND 50000 AS between_,
  NOT (asset_description LIKE 'a%') AS not_like, coalesce(ticker, '') <> '' AS not_empty, tx_date IS NOT NULL AND tx_date <= filed_date AS dated FROM {trade}""")(
    lambda t: t.trade.select("filing_id", "row_index", F.ilike("asset_description", F.lit("%EX%")).alias("like_any_case"), F.col("ticker").isNull().alias("is_null"), F.col("tx_type").isin("S", "S (partial)").alias("in_list"), F.col("amount").between(15001, 50000).alias("between_"), (~F.col("asset_description").like("a%")).alias("not_like"), (F.coalesce("ticker", F.lit("")) != "").alias("not_empty"), F.coalesce(F.col("tx_date") <= F.col("filed_date"), F.lit(False)).alias("dated"))
)
query("amount_order", "SELECT label, n, row_number() OVER (ORDER BY low, label)::INTEGER AS place FROM (SELECT " + _RANGE + " AS label, min(CASE WHEN amount <= 15000 THEN 1001 WHEN amount <= 50000 THEN 15001 WHEN amount <= 100000 THEN 50001 WHEN amount <= 250000 THEN 100001 WHEN amount <= 500000 THEN 250001 ELSE 500001 END) AS low, count(*) AS n FROM {trade} GROUP BY 1) x")(
    lambda t: core.ranked(trades.bucketed(t.trade).groupBy("label").agg(F.min("low").alias("low"), F.count("*").alias("n")), [], [F.asc("low"), F.asc("label")], "place").select("label", "n", "place")
)
query("chamber_and_source", "SELECT f.filing_id, CASE WHEN e.chamber = 'house' THEN 'House' ELSE 'Senate' END AS chamber, CASE WHEN e.chamber = 'senate' THEN 'HTML' ELSE 'PDF' END AS source FROM {filing} f JOIN {entity} e USING (entity_id)")(
    lambda t: t.filing.join(t.entity.select("entity_id", "chamber"), "entity_id").select("filing_id", S.chamber_label(F.col("chamber")).alias("chamber"), S.source_label(F.col("chamber")).alias("source"))
)
