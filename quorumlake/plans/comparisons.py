"""Further registered queries: comparisons, briefs, parsed lines and their repairs, resolution of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import AMOUNT_RANGES
from ..operators import compare, core, people, repairs, resolve
from ..sources import feeds
from .catalog import _COVER, _EFF, _LATEST, AS_OF, _topk_sql, query
from .fixtures import Tables

_SPONSOR = "(SELECT e.group_id, count(*) AS items FROM {entity} e JOIN {item_link} l ON l.entity_id = e.entity_id AND l.role = 'sponsor' WHERE e.in_office GROUP BY 1)"
_SIZES = """(SELECT group_id, count(*) AS members, count(*) FILTER (chamber = 'senate') AS senators, count(*) FILTER (chamber = 'house') AS representatives, count(*) FILTER (party = 'Democrat') AS democrats,
  count(*) FILTER (party = 'Republican') AS republicans, count(*) FILTER (party NOT IN ('Democrat', 'Republican')) AS others FROM {entity} WHERE in_office GROUP BY 1)"""


def _count(view: str, name: str) -> str:
    return f"(SELECT e.group_id, count(*) AS {name} FROM {{entity}} e JOIN {{{view}}} x ON x.entity_id = e.entity_id WHERE e.in_office GROUP BY 1)"


def _zero(*names: str) -> str:
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)


def _coverage(t: Tables) -> DataFrame:
    return people.committee_coverage(t.entity, t.assignment, t.committee)


def _profiles(t: Tables) -> DataFrame:
    return compare.profiles(t.entity, t.item_link, t.position, t.finance_cycle, _coverage(t))


query("state_rollup_compare", "SELECT group_id, g.name, " + _zero("members", "senators", "representatives", "democrats", "republicans", "others", "items", "raised", "with_finance", "seats", "committees") + ", CASE WHEN with_finance > 0 THEN CAST(round(raised / with_finance) AS BIGINT) END AS average_raised FROM {group_dim} g LEFT JOIN " + _SIZES + " s USING (group_id) LEFT JOIN " + _SPONSOR + " i USING (group_id) LEFT JOIN (SELECT e.group_id, sum(f.raised)::BIGINT AS raised, count(*) AS with_finance FROM {entity} e JOIN (SELECT entity_id, max(" + _EFF + ") AS raised FROM {finance_cycle} GROUP BY 1) f ON f.entity_id = e.entity_id WHERE e.in_office GROUP BY 1) m USING (group_id) LEFT JOIN (SELECT group_id, count(*) AS seats, count(DISTINCT committee_id) AS committees FROM (" + _COVER + ") c GROUP BY 1) c USING (group_id)")(lambda t: compare.group_rollup(t.group_dim, t.entity, t.item_link, t.finance_cycle, _coverage(t)))

_MONEY = "CASE WHEN raised >= 1000000 THEN '$' || ((raised + 50000) // 100000) // 10 || '.' || ((raised + 50000) // 100000) % 10 || 'M' WHEN raised >= 1000 THEN '$' || (raised + 500) // 1000 || 'K' ELSE '$' || raised END"
query("delegation_brief", """SELECT group_id, DATE '2001-06-30' - 7 AS period_start, DATE '2001-06-30' AS period_end, members, senators, representatives, democrats, republicans, items, raised, positions, seats, leadership, concat_ws(' ',
  name || '''s delegation has ' || senators || ' senator' || CASE WHEN senators = 1 THEN '' ELSE 's' END || ' and ' || representatives || ' representative' || CASE WHEN representatives = 1 THEN '' ELSE 's' END || ', ' ||
    CASE WHEN democrats = republicans THEN 'evenly split between parties' WHEN democrats > republicans THEN 'majority Democrat (' || democrats || 'D-' || republicans || 'R)' ELSE 'majority Republican (' || republicans || 'R-' || democrats || 'D)' END || '.',
  CASE WHEN items > 0 THEN 'The delegation has sponsored ' || items || ' bills in the 119th Congress.' END, CASE WHEN items > 0 THEN 'Most active sponsors: ' || top || '.' END,
  CASE WHEN raised > 0 THEN 'Across the delegation, members have reported ' || """ + _MONEY + """ || ' in total receipts, with ' || CAST(round(100.0 * pac / raised) AS BIGINT) || '% from PACs and ' || CAST(round(100.0 * small / raised) AS BIGINT) || '% from small-dollar individual contributions.' END,
  CASE WHEN positions > 0 THEN format('{:,}', positions) || ' individual vote positions have been recorded across the delegation.' END,
  CASE WHEN leadership > 0 THEN 'Committee leadership: ' || duties || '.' END, CASE WHEN seats > 0 THEN 'The delegation holds ' || seats || ' committee and subcommittee assignments.' END) AS summary
  FROM (SELECT group_id, g.name, members, senators, representatives, democrats, republicans, top, duties, """ + _zero("items", "raised", "pac", "small", "positions", "seats", "leadership") + " FROM " + _SIZES + " s JOIN {group_dim} g USING (group_id) LEFT JOIN " + _SPONSOR + " i USING (group_id) LEFT JOIN (SELECT group_id, string_agg(full_name || ' (' || items || ')', ', ' ORDER BY rn) AS top FROM (" + _topk_sql("*", "(SELECT e.group_id, e.full_name, count(*) AS items FROM {entity} e JOIN {item_link} l ON l.entity_id = e.entity_id AND l.role = 'sponsor' WHERE e.in_office GROUP BY 1, 2)", "group_id", "items DESC, full_name", 3) + ") y GROUP BY 1) ts USING (group_id) LEFT JOIN (SELECT e.group_id, sum(total_receipts)::BIGINT AS raised, sum(total_pac)::BIGINT AS pac, sum(small_individual)::BIGINT AS small FROM {entity} e JOIN " + _LATEST + " f ON f.entity_id = e.entity_id WHERE e.in_office GROUP BY 1) m USING (group_id) LEFT JOIN " + _count("position", "positions") + " p USING (group_id) LEFT JOIN " + _count("assignment", "seats") + " q USING (group_id) LEFT JOIN (SELECT group_id, count(*) AS leadership, string_agg(full_name || ' (' || replace(role, '_', ' ') || ' of ' || name || ')', '; ' ORDER BY full_name, name, role) AS duties FROM (" + _COVER + ") c WHERE role IN ('chair', 'ranking_member', 'vice_chair') GROUP BY 1) d USING (group_id)) z")(lambda t: compare.delegation_brief(*_told(t), AS_OF).drop("stats"))



def _told(t: Tables) -> list[DataFrame]:
    return [t.group_dim, t.entity, t.item_link, t.finance_cycle, t.position, t.assignment, t.committee]


query("delegation_stats", """SELECT group_id, '{"members":' || members || ',"senators":' || senators || ',"representatives":' || representatives || ',"democrat":' || democrats || ',"republican":' || republicans || ',"billsSponsored":' || items || ',"totalRaised":' || raised || ',"totalVotes":' || positions || ',"committeeSeats":' || seats || ',"leadershipRoles":' || leadership || '}' AS stats
  FROM (SELECT group_id, members, senators, representatives, democrats, republicans, """ + _zero("items", "raised", "positions", "seats", "leadership") + " FROM " + _SIZES + " s LEFT JOIN " + _SPONSOR + " i USING (group_id) LEFT JOIN (SELECT e.group_id, sum(total_receipts)::BIGINT AS raised FROM {entity} e JOIN " + _LATEST + " f ON f.entity_id = e.entity_id WHERE e.in_office GROUP BY 1) m USING (group_id) LEFT JOIN " + _count("position", "positions") + " p USING (group_id) LEFT JOIN " + _count("assignment", "seats") + " q USING (group_id) LEFT JOIN (SELECT group_id, count(*) AS leadership FROM (" + _COVER + ") c WHERE role IN ('chair', 'ranking_member', 'vice_chair') GROUP BY 1) d USING (group_id)) z")(lambda t: compare.delegation_stats(*_told(t)))

_LARGE = "greatest(0, total_individual - small_individual)"
_PROFILE = "(SELECT e.entity_id, e.group_id, e.full_name, e.chamber, e.party, " + _zero("sponsored", "cosponsored", "yea", "nay", "total") + ", f.cycle, " + ", ".join(f"CASE WHEN effective_total > 0 THEN CAST(round(100.0 * {c} / effective_total) AS BIGINT) WHEN effective_total IS NOT NULL THEN 0 END AS {n}" for c, n in (("small_individual", "small_pct"), (_LARGE, "large_pct"), ("total_pac", "pac_pct"))) + ", f.effective_total, " + _zero("committees") + " FROM {entity} e LEFT JOIN (SELECT entity_id, count(*) FILTER (role = 'sponsor') AS sponsored, count(*) FILTER (role = 'cosponsor') AS cosponsored FROM {item_link} GROUP BY 1) r USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) FILTER (position = 'yea') AS yea, count(*) FILTER (position = 'nay') AS nay, count(*) AS total FROM {position} GROUP BY 1) v USING (entity_id) LEFT JOIN " + _LATEST + " f USING (entity_id) LEFT JOIN (SELECT entity_id, count(DISTINCT committee_id) AS committees FROM (" + _COVER + ") c GROUP BY 1) k USING (entity_id) WHERE e.in_office)"
_FIELDS = ["group_id", "full_name", "chamber", "party", "sponsored", "cosponsored", "yea", "nay", "total", "cycle", "small_pct", "large_pct", "pac_pct", "effective_total", "committees"]


def _agree(on: str) -> str:
    return "(SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared, count(*) FILTER (x.position = y.position) AS agreed, CAST(round(100.0 * count(*) FILTER (x.position = y.position) / count(*)) AS BIGINT) AS pct FROM {position} x JOIN {position} y ON x.ballot_id = y.ballot_id AND " + on + " WHERE x.position IN ('yea', 'nay') AND y.position IN ('yea', 'nay') GROUP BY 1, 2)"


query("compare_entities", "SELECT p.entity_id AS a, q.entity_id AS b, " + ", ".join(f"{x}.{c} AS {n}_{c}" for x, n in (("p", "a"), ("q", "b")) for c in _FIELDS) + ", shared, agreed, pct FROM " + _PROFILE + " p JOIN " + _PROFILE + " q ON q.entity_id = p.entity_id + 1 LEFT JOIN " + _agree("y.entity_id = x.entity_id + 1") + " g ON g.a = p.entity_id AND g.b = q.entity_id AND p.chamber = q.chamber")(lambda t: compare.compare_entities(t.entity.select(F.col("entity_id").alias("a"), (F.col("entity_id") + 1).alias("b")), _profiles(t), t.position))
query("compare_delegation", "SELECT p.*, g.shared AS senators_shared, g.pct AS senators_pct FROM " + _PROFILE + " p LEFT JOIN (SELECT group_id, min(entity_id) AS a, max(entity_id) AS b FROM {entity} WHERE in_office AND chamber = 'senate' GROUP BY 1 HAVING count(*) = 2) s USING (group_id) LEFT JOIN " + _agree("x.entity_id < y.entity_id") + " g ON g.a = s.a AND g.b = s.b")(lambda t: compare.compare_delegation(_profiles(t), t.position))

# ---- parsed lines, repairs

_TYPES = ", ".join(f"'{x}'" for x in repairs.TX_TYPES)
_LABELS = ", ".join(f"'{r[0]}'" for r in AMOUNT_RANGES)
_ERRORS = f"concat_ws('; ', CASE WHEN tx_type IS NULL OR tx_type NOT IN ({_TYPES}) THEN 'invalid type' END, CASE WHEN amount_range IS NULL OR amount_range NOT IN ({_LABELS}) THEN 'invalid amount range' END, CASE WHEN NOT regexp_full_match(tx_date, '\\d\\d\\d\\d-\\d\\d-\\d\\d') THEN 'malformed date' END, CASE WHEN length(trim(coalesce(asset_description, ''))) < 2 THEN 'missing description' END)"
_KEYS = ["filing_id", "row_index"]


def _bound(i: int) -> str:
    return "CASE amount_range " + " ".join(f"WHEN '{r[0]}' THEN {r[i]}::BIGINT" for r in AMOUNT_RANGES if r[i] is not None) + " END"


query("validate_lines", "SELECT filing_id, row_index, errors FROM (SELECT *, " + _ERRORS + " AS errors FROM {line}) x WHERE errors <> ''")(lambda t: repairs.validate_lines(t.line))
query("build_filings", "SELECT f.filing_id, CASE WHEN bad THEN 'review' ELSE 'parsed' END AS parse_status, coalesce(c, 0) AS parse_confidence FROM {filing} f LEFT JOIN (SELECT filing_id, bool_or(" + _ERRORS + " <> '') AS bad, CAST(round(sum(CAST(round(confidence * 100) AS BIGINT)) / count(*)) AS INTEGER) AS c FROM {line} GROUP BY 1) l USING (filing_id)")(lambda t: repairs.build_filings(t.filing, t.line))
query("build_lines", "SELECT filing_id, row_index, " + _bound(1) + " AS amount_min, " + _bound(2) + " AS amount_max, coalesce(date_diff('day', CAST(tx_date AS DATE), filed_date) > 45, FALSE) AS filed_late, confidence < 0.8::DOUBLE AS needs_review, CAST(round(confidence * 100) AS INTEGER) AS confidence FROM {line}")(lambda t: repairs.build_lines(t.line))
query("drop_placeholders", f"SELECT filing_id, row_index, tx_type FROM {{line}} WHERE tx_type IN ({_TYPES})")(lambda t: repairs.drop_placeholders(t.line).select(*_KEYS, "tx_type"))
query("drop_template_rows", f"SELECT filing_id, row_index FROM {{line}} WHERE asset_description NOT ILIKE '%{repairs.TEMPLATE}%'")(lambda t: repairs.drop_template_rows(t.line).select(*_KEYS))
query("null_code_tickers", "SELECT filing_id, row_index, CASE WHEN ticker IN (" + ", ".join(f"'{x}'" for x in repairs.STOCK_CODES) + ") AND asset_type <> 'Stock' THEN NULL ELSE ticker END AS ticker FROM {line}")(lambda t: repairs.null_code_tickers(t.line).select(*_KEYS, "ticker"))
query("reclassify_by_tag", "SELECT filing_id, row_index, CASE WHEN code THEN NULL ELSE ticker END AS ticker, CASE WHEN contains(asset_description, '[CT]') AND kind IS NOT NULL THEN 'Cryptocurrency' ELSE kind END AS asset_type FROM (SELECT *, CASE WHEN code THEN CASE " + " ".join(f"WHEN contains(asset_description, '[{k}]') THEN '{v}'" for k, v in repairs.TAG_TYPES.items()) + " ELSE asset_type END ELSE asset_type END AS kind FROM (SELECT *, coalesce(ticker IN (" + ", ".join(f"'{x}'" for x in repairs.TAG_CODES) + "), FALSE) AS code FROM {line}) x) y")(lambda t: repairs.reclassify_by_tag(t.line).select(*_KEYS, "ticker", "asset_type"))
query("restore_by_pattern", "SELECT filing_id, row_index, CASE WHEN ticker IS NULL AND asset_description ILIKE '%(BA)%' THEN 'BA' ELSE ticker END AS ticker FROM {line}")(lambda t: repairs.restore_by_pattern(t.line).select(*_KEYS, "ticker"))
query("time_position", "SELECT filing_id, row_index, round(100.0 * date_diff('day', (SELECT min(tx_date) FROM {trade}), tx_date) / greatest(1, date_diff('day', (SELECT min(tx_date) FROM {trade}), (SELECT max(tx_date) FROM {trade}))), 4) AS pct FROM {trade}")(lambda t: repairs.time_position(t.trade, "tx_date").select(*_KEYS, F.round("pct", 4).alias("pct")))
query("random_sample", "SELECT filing_id, row_index, full_name FROM {trade} t JOIN {entity} e USING (entity_id) ORDER BY md5('0|' || filing_id || '|' || row_index), filing_id, row_index LIMIT 20")(lambda t: repairs.random_sample(t.trade.join(t.entity.select("entity_id", "full_name"), "entity_id"), _KEYS).select(*_KEYS, "full_name"))

# ---- items, names

query("sponsorships_round_trip", "SELECT DISTINCT 'hr-' || item_id || '-119' AS item_id, CAST(l.entity_id AS VARCHAR) AS entity_id, role FROM {item_link} l WHERE l.entity_id IN (SELECT entity_id FROM {entity} WHERE in_office) AND item_id IN (SELECT item_id FROM {item_link} WHERE role = 'sponsor' AND entity_id IN (SELECT entity_id FROM {entity} WHERE in_office))")(lambda t: _sponsorships(t))
_HITS = "(SELECT s.filing_id, e.entity_id, e.district = s.district AS same, s.district IS NULL AND e.chamber = 'senate' AS sen FROM {signer} s JOIN {person} e ON e.state = s.state AND e.last_name = s.last)"
_ONE = "(SELECT filing_id, min(entity_id) AS x FROM {h} WHERE {c} GROUP BY 1 HAVING count(DISTINCT entity_id) = 1)"
query("resolve_entity_lower", "SELECT s.filing_id, coalesce(a.x, b.x, c.x) AS entity_id FROM {signer} s LEFT JOIN " + _ONE.replace("{h}", _HITS + " h").replace("{c}", "TRUE") + " a USING (filing_id) LEFT JOIN " + _ONE.replace("{h}", _HITS + " h").replace("{c}", "same") + " b USING (filing_id) LEFT JOIN " + _ONE.replace("{h}", _HITS + " h").replace("{c}", "sen") + " c USING (filing_id)")(lambda t: resolve.resolve_lower(t.signer, t.person, "filing_id"))


def _sponsorships(t: Tables) -> DataFrame:
    """Items as bill records with their sponsors, many in parts, to JSON and back."""
    link = core.parts(t.item_link, "item_id", "entity_id").select("item_id", "part", "role", F.struct(F.col("entity_id").cast("string").alias("bioguideId")).alias("p"))
    who = link.groupBy("item_id", "part").agg(*(F.collect_list(F.when(F.col("role") == r, F.col("p"))).alias(f"{r}s") for r in ("sponsor", "cosponsor")))
    raw = t.item.join(who, "item_id").select(F.to_json(F.struct(F.lit("HR").alias("type"), F.col("item_id").cast("string").alias("number"), "title", "sponsors", "cosponsors")).alias("json"))
    tracked = t.entity.where("in_office").select(F.col("entity_id").cast("string").alias("entity_id"))
    kept = feeds.normalize_items(feeds.parse_json(raw, feeds.BILL), tracked, 119)
    return feeds.explode_sponsorships(kept, tracked).select("item_id", "entity_id", "role")
