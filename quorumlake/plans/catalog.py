"""The registered analytics queries: each an operator on the fixture tables, with DuckDB text for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import core, people, text, trades, votes
from ..sources import feeds, xml
from .fixtures import Tables, oracle

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = "2001-06-30"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


def _topk_sql(cols: str, source: str, key: str, order: str, k: int) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) x WHERE rn <= {k}"


# ---- ballots and positions

query("pairwise_agreement", """SELECT a, b, count(*) AS shared, sum(CASE WHEN pa = pb THEN 1 ELSE 0 END)::BIGINT AS agreed, CAST(round(100.0 * sum(CASE WHEN pa = pb THEN 1 ELSE 0 END) / count(*)) AS BIGINT) AS pct
  FROM (SELECT x.entity_id AS a, y.entity_id AS b, x.position AS pa, y.position AS pb FROM {position} x JOIN {position} y ON x.ballot_id = y.ballot_id AND x.entity_id < y.entity_id
        WHERE x.position IN ('yea','nay') AND y.position IN ('yea','nay')) p GROUP BY a, b""")(lambda t: votes.pairwise_agreement(t.position))
_POS = "count(*) FILTER (position = '{k}')"
query("position_summary", "SELECT entity_id, yea, nay, present, not_voting, total, " + ", ".join(f"CAST(round(100.0 * {k} / total) AS BIGINT) AS {k}_pct" for k in ("yea", "nay", "present", "not_voting")) + " FROM (SELECT entity_id, " + ", ".join(f"count(*) FILTER (position = '{k}') AS {k}" for k in ("yea", "nay", "present", "not_voting")) + ", count(*) AS total FROM {position} GROUP BY entity_id) s")(lambda t: votes.position_summary(t.position))
query("entity_recent_ballots", _topk_sql("entity_id, ballot_id, ballot_date, position", "(SELECT p.*, b.ballot_date FROM {position} p JOIN {ballot} b USING (ballot_id))", "entity_id", "ballot_date DESC, ballot_id DESC", 15))(lambda t: core.topk_per_key(t.position.join(t.ballot.select("ballot_id", "ballot_date"), "ballot_id"), ["entity_id"], [F.desc("ballot_date"), F.desc("ballot_id")], 15).select("entity_id", "ballot_id", "ballot_date", "position"))
query("group_recent_ballots", _topk_sql("group_id, ballot_id", "(SELECT DISTINCT e.group_id, p.ballot_id FROM {position} p JOIN {entity} e ON e.entity_id = p.entity_id AND e.in_office)", "group_id", "ballot_id DESC", 10))(lambda t: core.topk_per_key(votes.group_ballots(t.ballot, t.position, t.entity), ["group_id"], [F.desc("ballot_id")], 10).select("group_id", "ballot_id"))
query("ballot_events", """SELECT ballot_id, group_id, yea, nay, total, CASE WHEN yea = total THEN 'Unanimous Yea' WHEN nay = total THEN 'Unanimous Nay' ELSE yea || ' Yea, ' || nay || ' Nay' END AS title FROM (
  SELECT p.ballot_id, e.group_id, count(*) FILTER (position = 'yea') AS yea, count(*) FILTER (position = 'nay') AS nay, count(*) AS total
  FROM {position} p JOIN (SELECT ballot_id FROM {ballot} ORDER BY ballot_date DESC, ballot_id DESC LIMIT 100) b USING (ballot_id) JOIN {entity} e ON e.entity_id = p.entity_id AND e.in_office GROUP BY 1, 2) x""")(lambda t: votes.ballot_events(t.ballot, t.position, t.entity))
query("ballot_totals", "SELECT ballot_id, ballot_date, yeas::BIGINT AS yeas, nays::BIGINT AS nays FROM {ballot}")(lambda t: t.ballot)

# ---- entities, groups, committees

_BREAK = """SELECT g.group_id, g.name, count(e.entity_id) AS members, count(e.entity_id) FILTER (e.party = 'Democrat') AS democrats, count(e.entity_id) FILTER (e.party = 'Republican') AS republicans,
  count(e.entity_id) FILTER (e.party NOT IN ('Democrat', 'Republican')) AS others FROM {group_dim} g LEFT JOIN {entity} e ON e.group_id = g.group_id AND e.in_office GROUP BY 1, 2"""
query("category_breakdown", _BREAK)(lambda t: people.category_breakdown(t.group_dim, t.entity))
query("left_join_counts", "SELECT g.group_id, g.name, count(e.entity_id) AS members FROM {group_dim} g LEFT JOIN {entity} e ON e.group_id = g.group_id AND e.in_office GROUP BY 1, 2")(lambda t: people.category_breakdown(t.group_dim, t.entity).select("group_id", "name", "members"))
query("party_share", "SELECT group_id, " + ", ".join(f"coalesce(CAST(round(100.0 * {c} / nullif(members, 0)) AS BIGINT), 0) AS {c}_pct" for c in ("democrats", "republicans", "others")) + """,
  CASE WHEN members = 0 THEN 'none' WHEN democrats <> republicans AND greatest(democrats, republicans) / members > 0.65 THEN 'strong_' || CASE WHEN democrats > republicans THEN 'D' ELSE 'R' END
       WHEN democrats <> republicans AND greatest(democrats, republicans) / members > 0.5 THEN 'lean_' || CASE WHEN democrats > republicans THEN 'D' ELSE 'R' END ELSE 'split' END AS dominance FROM (""" + _BREAK + ") x")(lambda t: people.party_share(people.category_breakdown(t.group_dim, t.entity)))
query("active_entities_of_group", "SELECT group_id, entity_id, full_name, chamber, party, district FROM {entity} WHERE in_office")(lambda t: t.entity.where("in_office").select("group_id", "entity_id", "full_name", "chamber", "party", "district"))
query("entity_picker", "SELECT entity_id, full_name, party, group_id, chamber, district FROM {entity} WHERE in_office")(lambda t: t.entity.where("in_office").select("entity_id", "full_name", "party", "group_id", "chamber", "district"))
query("total_active", "SELECT count(*) AS n FROM {entity} WHERE in_office")(lambda t: t.entity.where("in_office").agg(F.count("*").alias("n")))
query("role_counts", "SELECT entity_id, count(*) FILTER (role = 'sponsor') AS sponsored, count(*) FILTER (role = 'cosponsor') AS cosponsored FROM {item_link} GROUP BY 1")(lambda t: people.role_counts(t.item_link))
_COVER = "SELECT c.committee_id, a.entity_id, e.group_id, e.full_name, a.role, c.name FROM {entity} e JOIN {assignment} a ON a.entity_id = e.entity_id JOIN {committee} c ON c.committee_id = a.committee_id AND c.parent_id IS NULL WHERE e.in_office"
query("group_committee_coverage", _COVER)(lambda t: people.committee_coverage(t.entity, t.assignment, t.committee))
query("entity_committees", "SELECT a.entity_id, c.committee_id, c.name, a.role FROM {assignment} a JOIN {committee} c USING (committee_id)")(lambda t: t.assignment.join(t.committee, "committee_id").select("entity_id", "committee_id", "name", "role"))
query("prefix_children", "SELECT p.committee_id AS parent, c.committee_id AS child FROM {committee} c JOIN {committee} p ON p.parent_id IS NULL AND starts_with(c.committee_id, p.committee_id) WHERE c.parent_id IS NOT NULL")(lambda t: people.subcommittees(t.committee))
query("committee_board", "SELECT group_id, committee_id, name, string_agg(full_name, '; ' ORDER BY rn) FILTER (rn <= 12) AS members, greatest(0, count(*) - 12) AS more FROM (SELECT *, row_number() OVER (PARTITION BY group_id, committee_id ORDER BY full_name, entity_id) AS rn FROM (" + _COVER + ") v) x GROUP BY 1, 2, 3")(lambda t: people.committee_board(people.committee_coverage(t.entity, t.assignment, t.committee)))
query("leadership_roles", "SELECT e.group_id, e.entity_id, c.name, a.role FROM {entity} e JOIN {assignment} a USING (entity_id) JOIN {committee} c USING (committee_id) WHERE e.in_office AND c.parent_id IS NULL AND a.role IN ('chair', 'ranking_member', 'vice_chair')")(lambda t: people.committee_coverage(t.entity, t.assignment, t.committee).where(F.col("role").isin("chair", "ranking_member", "vice_chair")).select("group_id", "entity_id", "name", "role"))
query("top_sponsors", _topk_sql("group_id, entity_id, full_name, items, rn::INTEGER AS rank", "(SELECT e.group_id, e.entity_id, e.full_name, count(*) AS items FROM {entity} e JOIN {item_link} l ON l.entity_id = e.entity_id AND l.role = 'sponsor' WHERE e.in_office GROUP BY 1, 2, 3)", "group_id", "items DESC, full_name, entity_id", 3))(lambda t: people.top_sponsors(t.entity, t.item_link))
query("group_item_count", "SELECT e.group_id, count(*) AS items FROM {entity} e JOIN {item_link} l ON l.entity_id = e.entity_id AND l.role = 'sponsor' WHERE e.in_office GROUP BY 1")(lambda t: t.entity.where("in_office").join(t.item_link.where("role = 'sponsor'"), "entity_id").groupBy("group_id").agg(F.count("*").alias("items")))
query("entity_items", _topk_sql("entity_id, item_id, role, introduced_date", "(SELECT l.*, i.introduced_date FROM {item_link} l JOIN {item} i USING (item_id))", "entity_id", "introduced_date DESC NULLS FIRST, item_id, role", 20))(lambda t: core.topk_per_key(t.item_link.join(t.item.select("item_id", "introduced_date"), "item_id"), ["entity_id"], [F.desc_nulls_first("introduced_date"), F.asc("item_id"), F.asc("role")], 20).select("entity_id", "item_id", "role", "introduced_date"))
query("group_recent_items", _topk_sql("group_id, entity_id, item_id, title, introduced_date", "(SELECT e.group_id, e.entity_id, i.* FROM {item_link} l JOIN {item} i USING (item_id) JOIN {entity} e ON e.entity_id = l.entity_id WHERE l.role = 'sponsor')", "group_id", "introduced_date DESC NULLS FIRST, item_id, entity_id", 15))(lambda t: core.topk_per_key(t.item_link.where("role = 'sponsor'").join(t.item, "item_id").join(t.entity.select("entity_id", "group_id"), "entity_id"), ["group_id"], [F.desc_nulls_first("introduced_date"), F.asc("item_id"), F.asc("entity_id")], 15).select("group_id", "entity_id", "item_id", "title", "introduced_date"))
query("item_events", "SELECT e.entity_id, e.group_id, i.item_id, e.full_name || ' introduced ' || i.item_type || ' ' || i.item_id AS title, i.introduced_date FROM {item_link} l JOIN {item} i USING (item_id) JOIN {entity} e ON e.entity_id = l.entity_id WHERE l.role = 'sponsor' AND i.introduced_date IS NOT NULL ORDER BY i.introduced_date DESC, i.item_id, e.entity_id LIMIT 500")(lambda t: t.item_link.where("role = 'sponsor'").join(t.item.where("introduced_date IS NOT NULL"), "item_id").join(t.entity, "entity_id").orderBy(F.desc("introduced_date"), "item_id", "entity_id").limit(500).select("entity_id", "group_id", "item_id", F.concat("full_name", F.lit(" introduced "), "item_type", F.lit(" "), F.col("item_id").cast("string")).alias("title"), "introduced_date"))
query("find_delegation", _topk_sql("group_id, district, seat, entity_id", "(SELECT a.group_id, a.district, e.district AS seat, e.entity_id FROM (SELECT g.group_id, d.district FROM {group_dim} g, (SELECT DISTINCT district FROM {entity}) d) a JOIN {entity} e ON e.group_id = a.group_id AND e.in_office AND e.chamber = 'house' AND (e.district = a.district OR e.district = 0))", "group_id, district", "(CASE WHEN seat = district THEN 0 ELSE 1 END), entity_id", 1))(lambda t: people.find_delegation(t.group_dim.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("district")), t.entity).select("group_id", "district", "seat", "entity_id"))

# ---- finance

_EFF = "CASE WHEN total_receipts > 0 THEN total_receipts ELSE greatest(total_individual, small_individual) + total_pac END"
_LATEST = "(SELECT *, " + _EFF + " AS effective_total FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY cycle DESC) AS rn FROM {finance_cycle}) y WHERE rn = 1)"
query("entity_finance", "SELECT entity_id, cycle, total_receipts, total_individual, total_pac, small_individual FROM {finance_cycle}")(lambda t: t.finance_cycle)
query("effective_total", "SELECT entity_id, cycle, " + _EFF + " AS effective_total FROM {finance_cycle}")(lambda t: t.finance_cycle.select("entity_id", "cycle", S.effective_total(F.col("total_receipts"), F.col("total_individual"), F.col("small_individual"), F.col("total_pac")).alias("effective_total")))
query("latest_cycle_per_entity", "SELECT entity_id, cycle, total_receipts, total_individual, total_pac, small_individual, effective_total FROM " + _LATEST + " x")(lambda t: people.latest_finance(t.finance_cycle))
query("funding_mix", "SELECT entity_id, cycle, small_individual AS small, greatest(0, total_individual - small_individual) AS large, total_pac AS pac, " + ", ".join(f"CASE WHEN effective_total > 0 THEN CAST(round(100.0 * {c} / effective_total) AS BIGINT) ELSE 0 END AS {n}" for c, n in (("small_individual", "small_pct"), ("greatest(0, total_individual - small_individual)", "large_pct"), ("total_pac", "pac_pct"))) + " FROM " + _LATEST + " x")(lambda t: people.funding_mix(people.latest_finance(t.finance_cycle)))
query("group_finance", "SELECT e.group_id, e.entity_id, f.cycle, f.total_receipts FROM {entity} e JOIN {finance_cycle} f USING (entity_id) WHERE e.in_office")(lambda t: t.entity.where("in_office").select("entity_id", "group_id").join(t.finance_cycle, "entity_id").select("group_id", "entity_id", "cycle", "total_receipts"))
query("share_of_max", "SELECT e.group_id, e.entity_id, greatest(3, CAST(round(100.0 * effective_total / nullif(max(effective_total) OVER (PARTITION BY e.group_id), 0)) AS BIGINT)) AS bar FROM {entity} e JOIN " + _LATEST + " f ON f.entity_id = e.entity_id WHERE e.in_office")(lambda t: people.share_of_max(t.entity, people.latest_finance(t.finance_cycle)))
query("fmt_money", "SELECT entity_id, cycle, CASE WHEN r >= 1000000 THEN '$' || ((r + 50000) // 100000) // 10 || '.' || ((r + 50000) // 100000) % 10 || 'M' WHEN r >= 1000 THEN '$' || (r + 500) // 1000 || 'K' ELSE '$' || r END AS money FROM (SELECT *, total_receipts AS r FROM {finance_cycle}) x")(lambda t: t.finance_cycle.select("entity_id", "cycle", S.fmt_money(F.col("total_receipts")).alias("money")))
query("missing_dependents", "SELECT entity_id FROM {entity} WHERE in_office AND entity_id NOT IN (SELECT entity_id FROM {finance_cycle})")(lambda t: core.only_new(t.entity.where("in_office"), t.finance_cycle, ["entity_id"]).select("entity_id"))

# ---- trades

query("entity_trades", "SELECT entity_id, filing_id, row_index, tx_type, tx_date, amount, filed_late FROM {trade}")(lambda t: t.trade.select("entity_id", "filing_id", "row_index", "tx_type", "tx_date", "amount", "filed_late"))
query("late_lines", "SELECT filing_id, row_index, filed_late FROM {trade} WHERE tx_date IS NOT NULL")(lambda t: t.trade.where("tx_date IS NOT NULL").select("filing_id", "row_index", F.coalesce(F.datediff("filed_date", "tx_date") > 45, F.lit(False)).alias("filed_late")))
query("line_date_anomaly", "SELECT filing_id, row_index FROM {trade} WHERE tx_date > filed_date")(lambda t: t.trade.where("tx_date > filed_date").select("filing_id", "row_index"))
query("traders", "SELECT entity_id, count(*) AS trades FROM {trade} GROUP BY 1")(lambda t: t.trade.groupBy("entity_id").agg(F.count("*").alias("trades")))
query("top_traders", "SELECT entity_id, count(*) AS trades FROM {trade} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(lambda t: t.trade.groupBy("entity_id").agg(F.count("*").alias("trades")).orderBy(F.desc("trades"), "entity_id").limit(5))
query("monthly_by_category", "SELECT strftime(tx_date, '%Y-%m') AS month, count(*) FILTER (party = 'Democrat') AS democrats, count(*) FILTER (party = 'Republican') AS republicans, count(*) FILTER (party NOT IN ('Democrat', 'Republican')) AS others, count(*) AS total FROM {trade} JOIN {entity} USING (entity_id) WHERE tx_date >= DATE '2001-06-30' - INTERVAL 14 MONTH AND tx_date <= DATE '2001-06-30' GROUP BY 1")(lambda t: trades.monthly(t.trade, t.entity, AS_OF))
_MONTHS = "SELECT strftime(tx_date, '%Y-%m') AS month, count(*) FILTER (tx_type = 'P') AS buys, count(*) FILTER (tx_type <> 'P') AS sells FROM {trade} WHERE tx_date IS NOT NULL GROUP BY 1"
query("monthly_buy_sell", _MONTHS)(lambda t: trades.monthly_buy_sell(t.trade))
query("peak_month", "SELECT month, greatest(1, buys + sells) AS total FROM (" + _MONTHS + ") x ORDER BY buys + sells DESC, month LIMIT 1")(lambda t: trades.monthly_buy_sell(t.trade).orderBy((F.col("buys") + F.col("sells")).desc(), "month").limit(1).select("month", F.greatest(F.lit(1), F.col("buys") + F.col("sells")).alias("total")))
query("ticker_rollup", "SELECT ticker, count(DISTINCT entity_id) AS members, count(*) AS trades, count(*) FILTER (tx_type = 'P') AS buys, count(*) FILTER (tx_type <> 'P') AS sells, strftime(min(tx_date), '%Y-%m') AS first_month, strftime(max(tx_date), '%Y-%m') AS last_month FROM {trade} WHERE ticker IS NOT NULL GROUP BY 1")(lambda t: trades.ticker_rollup(t.trade))
query("ticker_holders", "SELECT ticker, entity_id, count(*) AS trades, count(*) FILTER (tx_type = 'P') AS buys, count(*) FILTER (tx_type LIKE 'S%') AS sells, max(tx_date) AS latest FROM {trade} WHERE ticker IS NOT NULL GROUP BY 1, 2")(lambda t: trades.ticker_holders(t.trade))
_RANGE = "CASE " + " ".join(f"WHEN amount <= {hi} THEN '{label}'" for label, _, hi in S.AMOUNT_RANGES[:-1]) + f" ELSE '{S.AMOUNT_RANGES[-1][0]}' END"
query("bucket_range_join", "SELECT filing_id, row_index, " + _RANGE + " AS label FROM {trade}")(lambda t: trades.bucketed(t.trade).select("filing_id", "row_index", "label"))
query("amount_distribution", "SELECT " + _RANGE + " AS label, count(*) AS n FROM {trade} GROUP BY 1")(lambda t: trades.bucketed(t.trade).groupBy("label").agg(F.count("*").alias("n")))
query("confidence_bands", "SELECT CASE WHEN confidence >= 95 THEN '95-100' WHEN confidence >= 90 THEN '90-94' WHEN confidence >= 80 THEN '80-89' ELSE '<80' END AS band, count(*) AS n FROM {trade} GROUP BY 1")(lambda t: t.trade.groupBy(F.when(F.col("confidence") >= 95, "95-100").when(F.col("confidence") >= 90, "90-94").when(F.col("confidence") >= 80, "80-89").otherwise("<80").alias("band")).agg(F.count("*").alias("n")))
query("flag_distribution", "SELECT parse_status, filed_late, count(*) AS n FROM {trade} JOIN {filing} f USING (filing_id) GROUP BY 1, 2")(lambda t: t.trade.join(t.filing.select("filing_id", "parse_status"), "filing_id").groupBy("parse_status", "filed_late").agg(F.count("*").alias("n")))
query("distinct_multi", "SELECT count(*) AS n, count(DISTINCT entity_id) AS members, count(DISTINCT filing_id) AS filings FROM {trade}")(lambda t: t.trade.agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("members"), F.count_distinct("filing_id").alias("filings")))
query("distinct_values", "SELECT DISTINCT asset_description FROM {trade} WHERE ticker IS NULL")(lambda t: t.trade.where("ticker IS NULL").select("asset_description").distinct())
query("header_line_counts", "SELECT f.filing_id, f.parse_status, (SELECT count(*) FROM {trade} t WHERE t.filing_id = f.filing_id) AS lines FROM {filing} f")(lambda t: t.filing.select("filing_id", "parse_status").join(t.trade.groupBy("filing_id").agg(F.count("*").alias("n")), "filing_id", "left").select("filing_id", "parse_status", F.coalesce("n", F.lit(0)).alias("lines")))
query("open_filings", "SELECT f.filing_id, f.parse_status, e.full_name FROM {filing} f LEFT JOIN {entity} e USING (entity_id) WHERE f.parse_status NOT IN ('parsed')")(lambda t: t.filing.where("parse_status <> 'parsed'").join(t.entity.select("entity_id", "full_name"), "entity_id", "left").select("filing_id", "parse_status", "full_name"))
query("lowest_confidence", "SELECT t.filing_id, t.row_index, t.confidence, e.full_name FROM {trade} t JOIN {entity} e USING (entity_id) WHERE t.confidence < 90 ORDER BY t.confidence, t.filing_id, t.row_index LIMIT 100")(lambda t: t.trade.where("confidence < 90").join(t.entity.select("entity_id", "full_name"), "entity_id").orderBy("confidence", "filing_id", "row_index").limit(100).select("filing_id", "row_index", "confidence", "full_name"))
query("month_axis", "SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS tick FROM (SELECT date_trunc('month', min(tx_date)) AS a, date_trunc('month', max(tx_date)) AS b FROM {trade}) x")(lambda t: trades.month_axis(t.trade))
query("log_size", "SELECT filing_id, row_index, round(CASE WHEN hi > lo THEN 2.0 + 6.0 * (x - lo) / (hi - lo) ELSE 2.0 END, 4) AS size FROM (SELECT *, min(x) OVER (PARTITION BY entity_id) AS lo, max(x) OVER (PARTITION BY entity_id) AS hi FROM (SELECT filing_id, row_index, entity_id, ln(greatest(amount, 1)) AS x FROM {trade}) y) z")(lambda t: trades.log_size(t.trade))
query("latest_trade_per_entity", "SELECT entity_id, max(tx_date) AS latest FROM {trade} GROUP BY 1")(lambda t: t.trade.groupBy("entity_id").agg(F.max("tx_date").alias("latest")))
query("review_flag", "SELECT filing_id, row_index, confidence < 80 AS needs_review FROM {trade}")(lambda t: t.trade.select("filing_id", "row_index", (F.col("confidence") < 80).alias("needs_review")))
query("rule_check", "SELECT filing_id, 'dated' AS rule FROM {trade} WHERE tx_date IS NULL UNION ALL SELECT filing_id, 'filed after' FROM {trade} WHERE tx_date > filed_date UNION ALL SELECT filing_id, 'confidence' FROM {trade} WHERE confidence < 70")(lambda t: core.rule_violations(t.trade, "filing_id", {"dated": F.col("tx_date").isNotNull(), "filed after": F.col("tx_date") <= F.col("filed_date"), "confidence": F.col("confidence") >= 70}))
query("duplicate_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda t: core.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]))

# ---- releases, timelines, runs

query("release_ranking", "SELECT e.entity_id, count(r.release_id) AS releases FROM {entity} e LEFT JOIN {release} r USING (entity_id) WHERE e.in_office GROUP BY 1")(lambda t: t.entity.where("in_office").select("entity_id").join(t.release.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("releases")))
query("group_releases", _topk_sql("group_id, release_id, title, published", "(SELECT e.group_id, r.* FROM {release} r JOIN {entity} e USING (entity_id))", "group_id", "published DESC NULLS FIRST, release_id", 10))(lambda t: core.topk_per_key(t.release.join(t.entity.select("entity_id", "group_id"), "entity_id"), ["group_id"], [F.desc_nulls_first("published"), F.asc("release_id")], 10).select("group_id", "release_id", "title", "published"))
query("entity_releases", _topk_sql("entity_id, release_id, published", "{release}", "entity_id", "published DESC NULLS FIRST, release_id", 10))(lambda t: core.topk_per_key(t.release, ["entity_id"], [F.desc_nulls_first("published"), F.asc("release_id")], 10).select("entity_id", "release_id", "published"))
query("keywords", "SELECT source, term, n, FALSE AS is_phrase, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rn FROM (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(string_split_regex(regexp_replace(lower(title), '[^a-z\\s''-]', '', 'g'), '\\s+')) AS term FROM {release}) w WHERE length(term) > 3 AND term NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY 1, 2 HAVING count(*) >= 2) c) x WHERE rn <= 12")(lambda t: text.keywords(t.release, "source"))
query("activity_timeline", """SELECT entity_id, date, kind, id, title, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, k, r) AS rn FROM (
  SELECT * FROM (SELECT entity_id, published AS date, 0 AS k, 'press' AS kind, release_id::VARCHAR AS id, title, row_number() OVER (PARTITION BY entity_id ORDER BY published DESC, release_id::VARCHAR) AS r FROM {release} WHERE published IS NOT NULL) WHERE r <= 50
  UNION ALL SELECT * FROM (SELECT l.entity_id, introduced_date, 1, 'bill', item_id::VARCHAR, title, row_number() OVER (PARTITION BY l.entity_id ORDER BY introduced_date DESC, item_id::VARCHAR) AS r FROM (SELECT DISTINCT item_id, entity_id FROM {item_link}) l JOIN {item} USING (item_id) WHERE introduced_date IS NOT NULL) WHERE r <= 30
  UNION ALL SELECT * FROM (SELECT entity_id, ballot_id::DATE, 2, 'vote', strftime(ballot_id, '%Y-%m-%d %H'), position, row_number() OVER (PARTITION BY entity_id ORDER BY ballot_id::DATE DESC, strftime(ballot_id, '%Y-%m-%d %H')) AS r FROM {position}) WHERE r <= 30) u) x WHERE rn <= 30""")(lambda t: text.activity_timeline(
    t.release.select("entity_id", F.col("published").alias("date"), F.col("release_id").alias("id"), "title"),
    t.item_link.select("item_id", "entity_id").distinct().join(t.item, "item_id").select("entity_id", F.col("introduced_date").alias("date"), F.col("item_id").alias("id"), "title"),
    t.position.select("entity_id", F.col("ballot_id").cast("date").alias("date"), F.date_format("ballot_id", "yyyy-MM-dd HH").alias("id"), F.col("position").alias("title"))))
query("entity_coverage", "SELECT entity_id, " + ", ".join(f"CASE WHEN entity_id IN (SELECT entity_id FROM {{{v}}}) THEN 'good' ELSE 'none' END AS {n}" for n, v in (("votes", "position"), ("finance", "finance_cycle"), ("releases", "release"), ("trades", "trade"))) + " FROM {entity}")(lambda t: people.coverage_flags(t.entity, {"votes": t.position, "finance": t.finance_cycle, "releases": t.release, "trades": t.trade}))
query("group_coverage", "SELECT e.group_id, count(*) AS members, count(*) FILTER (e.entity_id IN (SELECT entity_id FROM {release})) AS with_releases, count(*) FILTER (e.entity_id IN (SELECT entity_id FROM {finance_cycle})) AS with_finance FROM {entity} e WHERE e.in_office GROUP BY 1")(lambda t: t.entity.where("in_office").select("entity_id", "group_id").join(people.coverage_flags(t.entity, {"r": t.release, "f": t.finance_cycle}), "entity_id").groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.col("r") == "good").alias("with_releases"), F.count_if(F.col("f") == "good").alias("with_finance")))
query("latest_run_per_source", "SELECT source, entity_type, run_id, completed_at FROM (SELECT *, row_number() OVER (PARTITION BY source, entity_type ORDER BY completed_at DESC, run_id DESC) AS rn FROM {run_log} WHERE status = 'success' AND records_count > 0) x WHERE rn = 1")(lambda t: core.latest_per_key(t.run_log.where("status = 'success' AND records_count > 0"), ["source", "entity_type"], [F.desc("completed_at"), F.desc("run_id")]).select("source", "entity_type", "run_id", "completed_at"))
query("incremental_since", "SELECT source, entity_type, max(completed_at) FILTER (status = 'success' AND records_count > 0) - INTERVAL 1 DAY AS since FROM {run_log} GROUP BY 1, 2")(lambda t: core.incremental_since(t.run_log, ["source", "entity_type"]))
query("freshness", "SELECT source, floor(date_diff('second', max(completed_at), TIMESTAMP '2024-01-31 00:00:00') / 3600)::BIGINT AS hours FROM {run_log} WHERE status = 'success' AND records_count > 0 GROUP BY 1")(lambda t: t.run_log.where("status = 'success' AND records_count > 0").groupBy("source").agg(F.floor((F.unix_timestamp(F.lit("2024-01-31 00:00:00")) - F.unix_timestamp(F.date_trunc("second", F.max("completed_at")))) / 3600).cast("long").alias("hours")))
query("recent_runs", "SELECT run_id, source, status FROM {run_log} ORDER BY completed_at DESC, run_id DESC LIMIT 10")(lambda t: t.run_log.orderBy(F.desc("completed_at"), F.desc("run_id")).limit(10).select("run_id", "source", "status"))
query("table_stats", "SELECT 'entity' AS name, count(*) AS n FROM {entity} UNION ALL SELECT 'filing', count(*) FROM {filing} UNION ALL SELECT 'trade', count(*) FROM {trade} UNION ALL SELECT 'release', count(*) FROM {release} UNION ALL SELECT 'position', count(*) FROM {position}")(lambda t: _stats(t))
query("insert_ignore", "SELECT entity_id, cycle FROM (SELECT DISTINCT entity_id, cycle FROM {finance_cycle}) x")(lambda t: core.insert_ignore(t.finance_cycle.where("cycle < 1998").select("entity_id", "cycle"), t.finance_cycle.select("entity_id", "cycle"), ["entity_id", "cycle"], [F.asc("cycle")]))
query("upsert", "SELECT entity_id, cycle, CASE WHEN cycle >= 1998 THEN total_receipts + 1 ELSE total_receipts END AS total_receipts, total_pac FROM {finance_cycle}")(lambda t: core.upsert(t.finance_cycle.select("entity_id", "cycle", "total_receipts", "total_pac"), t.finance_cycle.where("cycle >= 1998").select("entity_id", "cycle", (F.col("total_receipts") + 1).alias("total_receipts"), F.lit(-1).cast("long").alias("total_pac")), ["entity_id", "cycle"], ["total_receipts"], [F.asc("cycle")]))
query("fk_guard", "SELECT l.item_id, l.entity_id, l.role FROM {item_link} l WHERE l.item_id IN (SELECT item_id FROM {item} WHERE introduced_date IS NOT NULL)")(lambda t: core.fk_guard(t.item_link, t.item.where("introduced_date IS NOT NULL"), ["item_id"])[0].select("item_id", "entity_id", "role"))
query("content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")(lambda t: feeds.content_hash(t.pages, "html").select("page_id", "content_hash"))
query("xml_tag", "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages")(lambda t: t.pages.select("page_id", S.xml_tag(F.col("html"), "title").alias("title")))
query("fold_name", f"SELECT doc_id, translate(lower(text), '{S.ACCENTED}', '{S.FOLDED}') AS folded FROM documents")(lambda t: t.documents.select("doc_id", S.fold_name(F.col("text")).alias("folded")))
_TYPE = "CASE tx_type WHEN 'P' THEN 'P' WHEN 'S' THEN 'S' ELSE 'S (partial)' END AS tx_type"
query("html_trades_round_trip", "SELECT filing_id, CAST(row_number() OVER (PARTITION BY filing_id ORDER BY row_index) - 1 AS INTEGER) AS row_index, tx_date, 'SP' AS owner_code, ticker, coalesce(asset_description, '--') AS asset_description, 'Stock' AS asset_type, " + _TYPE + ", " + _RANGE + " AS amount_range FROM {trade}")(lambda t: _html_round_trip(t))
query("rollcall_round_trip", "SELECT ballot_id, CAST(entity_id AS VARCHAR) AS entity_id, position FROM {position} WHERE entity_id IS NOT NULL")(lambda t: _rollcall_round_trip(t))
_DECODED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _entity, _plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#35;", "#"), ("&#39;", "''"), ("&quot;", '"'), ("&nbsp;", " ")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_plain}')"
query("html_text", f"SELECT page_id, trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')) AS text FROM pages")(lambda t: t.pages.select("page_id", S.html_text(F.col("html")).alias("text")))
query("terms_round_trip", "SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS end_date, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1 AS is_current FROM orders")(lambda t: _terms(t))


def _stats(t: Tables) -> DataFrame:
    out = None
    for name in ("entity", "filing", "trade", "release", "position"):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def _html_round_trip(t: Tables) -> DataFrame:
    """Trades rendered as one HTML table a filing and parsed back."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("--")), F.lit("</td>"))
    label = trades.bucketed(t.trade)
    row = F.concat(F.lit("<tr>"), cell(F.col("row_index").cast("string")), cell(F.date_format("tx_date", "MM/dd/yyyy")), cell(F.lit("Spouse")), cell(F.col("ticker")), cell(F.col("asset_description")), cell(F.lit("Stock")), cell(F.when(F.col("tx_type") == "P", "Purchase").when(F.col("tx_type") == "S", "Sale (Full)").otherwise("Sale (Partial)")), cell(F.col("label")), cell(F.lit("")), F.lit("</tr>"))
    pages = label.select("filing_id", F.struct("row_index", row.alias("row")).alias("r")).groupBy("filing_id").agg(F.concat(F.lit('<table class="table"><tbody>'), F.array_join(F.sort_array(F.collect_list("r"))["row"], ""), F.lit("</tbody></table>")).alias("html"))
    return feeds.parse_html_trades(pages, "filing_id").select("filing_id", "row_index", "tx_date", "owner_code", "ticker", "asset_description", "asset_type", "tx_type", "amount_range")


def _rollcall_round_trip(t: Tables) -> DataFrame:
    """Positions rendered as roll-call XML, large ballots in parts, and parsed back."""
    vote = F.concat(F.lit('<recorded-vote><legislator name-id="'), F.col("entity_id").cast("string"), F.lit('"/><vote>'), F.initcap("position"), F.lit("</vote></recorded-vote>"))
    body = F.concat(F.lit("<rollcall-vote><vote-metadata><vote-question>On Passage</vote-question></vote-metadata><vote-data>"), F.array_join(F.sort_array(F.collect_list(vote)), ""), F.lit("</vote-data></rollcall-vote>"))
    docs = core.parts(t.position.where("entity_id IS NOT NULL"), "ballot_id", "entity_id").groupBy("ballot_id", "part").agg(body.alias("xml"))
    keyed = docs.select(F.year("ballot_id").alias("year"), F.unix_timestamp("ballot_id").alias("roll"), "xml")
    _, positions, _ = xml.house_rolls(keyed, 119)
    return positions.select(F.timestamp_seconds(F.substring_index("vote_id", "-", -1).cast("long")).alias("ballot_id"), "entity_id", "position")


def _terms(t: Tables) -> DataFrame:
    """Customers as nested person records with their orders as terms, to JSON and back.

    Long careers are written in parts: of the parts' last terms the latest is the current one.
    """
    term = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("start"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("end"), F.lit("sen").alias("type"))
    persons = core.parts(t.orders, "o_custkey", "o_orderkey").groupBy("o_custkey", "part").agg(F.sort_array(F.collect_list(term)).alias("terms")).select(F.to_json(F.struct(F.struct(F.col("o_custkey").cast("string").alias("bioguide")).alias("id"), "terms")).alias("json"))
    terms = feeds.explode_terms(feeds.parse_json(persons, feeds.PERSON))
    last = terms.where("is_current").groupBy("entity_id").agg(F.max(F.struct("start_date", "end_date")).alias("last"))
    current = F.col("is_current") & (F.struct("start_date", "end_date") == F.col("last"))
    return terms.join(last, "entity_id").select("entity_id", "start_date", "end_date", current.alias("is_current"))
