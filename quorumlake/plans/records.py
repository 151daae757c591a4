"""Round trips of landed records: tables written as the feeds would hold them, parsed again, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import core, resolve
from ..sources import feeds, xml
from .catalog import query
from .fixtures import Tables

_TREE = "SELECT committee_id AS id, name, parent_id FROM {committee}"


@query("committee_tree_round_trip", _TREE)
def _tree(t: Tables) -> DataFrame:
    """Committees nested with their subcommittees, as JSON; the id sits in one of three fields."""
    child = t.committee.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.collect_list(F.struct(F.expr("substring(committee_id, length(parent_id) + 1)").alias("id"), "name")).alias("subcommittees"))
    top = t.committee.where("parent_id IS NULL").select(F.col("committee_id").alias("id"), "name").join(child, "id", "left")
    ids = ("thomas_id", "house_committee_id", "senate_committee_id")
    place = F.pmod(F.xxhash64("id"), F.lit(3))
    raw = top.select(F.to_json(F.struct(*(F.when(place >= i, F.when(place == i, F.col("id")).otherwise("")).alias(c) for i, c in enumerate(ids)), "name", "subcommittees")).alias("json"))
    schema = ", ".join(f"{c} STRING" for c in ids) + ", name STRING, subcommittees ARRAY<STRUCT<id: STRING, name: STRING>>"
    return feeds.flatten_tree(feeds.parse_json(raw, schema), ids)


@query("membership_round_trip", "SELECT committee_id, CAST(entity_id AS VARCHAR) AS entity_id, role FROM {assignment} WHERE entity_id % 5 <> 0")
def _membership(t: Tables) -> DataFrame:
    """An entity's seats, many in parts, as a map of committee to members; every fifth member lacks an id."""
    title = "CASE role WHEN 'chair' THEN 'Chairman' WHEN 'ranking_member' THEN 'Ranking Member' WHEN 'vice_chair' THEN 'Vice Chair' END AS title"
    member = t.assignment.selectExpr("entity_id", "committee_id", "CASE WHEN entity_id % 5 <> 0 THEN CAST(entity_id AS STRING) END AS bioguide", title)
    maps = core.parts(member, "entity_id", "committee_id").groupBy("entity_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("committee_id", F.array(F.struct("bioguide", "title"))))).alias("members"))
    raw = maps.select(F.to_json(F.struct("members")).alias("json"))
    return feeds.explode_membership(feeds.parse_json(raw, "members MAP<STRING, ARRAY<STRUCT<bioguide: STRING, title: STRING>>>"))


@query("item_from_text", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'hr-' WHEN 1 THEN 's-' WHEN 2 THEN 'hjres-' END || item_id || '-119' AS linked FROM {item}")
def _linked(t: Tables) -> DataFrame:
    named = t.item.selectExpr("item_id", "CASE item_id % 4 WHEN 0 THEN concat('H R ', item_id) WHEN 1 THEN concat('S ', item_id) WHEN 2 THEN concat('H J RES ', item_id) ELSE 'MOTION TO ADJOURN' END AS text")
    return named.select("item_id", S.item_from_text(F.col("text"), F.lit(119)).alias("linked"))


@query("feed_round_trip", "SELECT release_id, source || ' & ' || release_id AS title, 'https://' || url AS url, CAST(epoch(CAST(published AS TIMESTAMP)) AS BIGINT) AS published, 'On ' || source AS description FROM {release} WHERE release_id % 7 <> 0")
def _feed(t: Tables) -> DataFrame:
    """Releases as RSS, or as Atom (odd ids); every seventh lacks an http link."""
    link = "concat(CASE WHEN release_id % 7 = 0 THEN 'ftp://' ELSE 'https://' END, url)"
    head = "coalesce(source, '')"
    rss = f"concat('<rss><channel><item><title>', {head}, ' &amp; ', release_id, '</title><link>', {link}, '</link>', coalesce(concat('<pubDate>', date_format(published, 'd MMM yyyy'), ' 00:00:00 GMT</pubDate>'), ''), '<description><![CDATA[<p>On ', {head}, '</p>]]></description></item></channel></rss>')"
    atom = f"concat('<feed><item><title></title></item><entry><title>', {head}, ' &amp; ', release_id, '</title><link rel=\"self\" href=\"', {link}, '\"/>', coalesce(concat('<updated>', date_format(published, 'yyyy-MM-dd'), 'T00:00:00Z</updated>'), ''), '<content>On ', {head}, '</content></entry></feed>')"
    raw = t.release.selectExpr("release_id", f"CASE WHEN release_id % 2 = 0 THEN {rss} ELSE {atom} END AS xml")
    return feeds.parse_feed_items(raw, "release_id").withColumn("published", F.unix_timestamp("published"))


@query("manifest_round_trip", "SELECT CAST(filing_id AS VARCHAR) AS doc_id, 'Name' || entity_id AS last, 'Given' AS first, filed_date, left(name, 2) AS state, district FROM {filing} JOIN {entity} USING (entity_id) JOIN {group_dim} g USING (group_id)")
def _manifest(t: Tables) -> DataFrame:
    """Filings as index documents of at most 50 members each."""
    who = t.filing.join(t.entity, "entity_id").join(t.group_dim, "group_id")
    member = who.selectExpr("filing_id div 50 AS part", "concat('<Member><DocID>', filing_id, '</DocID><Last>Name', entity_id, '</Last><First>Given</First><FilingDate>', date_format(filed_date, 'M/d/yyyy'), '</FilingDate><StateDst>', left(name, 2), lpad(district, 2, '0'), '</StateDst></Member>') AS m")
    raw = member.groupBy("part").agg(F.concat(F.lit("<FinancialDisclosure>"), F.array_join(F.collect_list("m"), "\n"), F.lit("</FinancialDisclosure>")).alias("xml"))
    return xml.manifest(raw)[0]


_SENATOR = "(SELECT entity_id, last_name, CASE entity_id % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'ber' ELSE 'car' END AS given FROM {person} WHERE chamber = 'senate')"
_NAMED = "(SELECT s.filing_id, CASE s.filing_id % 4 WHEN 0 THEN 'ann' WHEN 1 THEN 'ber' WHEN 2 THEN 'car' ELSE 'dor' END AS wanted, e.given, e.entity_id FROM {signer} s JOIN " + _SENATOR + " e ON e.last_name = s.last)"


@query("resolve_entity_upper", "SELECT s.filing_id, coalesce(a.x, b.x) AS entity_id FROM {signer} s LEFT JOIN (SELECT filing_id, min(entity_id) AS x FROM " + _NAMED + " h GROUP BY 1 HAVING count(DISTINCT entity_id) = 1) a USING (filing_id) LEFT JOIN (SELECT filing_id, min(entity_id) AS x FROM " + _NAMED + " h WHERE given = wanted GROUP BY 1) b USING (filing_id)")
def _upper(t: Tables) -> DataFrame:
    person = t.person.withColumn("first_name", F.expr("CASE entity_id % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Berthold' ELSE 'Carl' END"))
    signer = t.signer.selectExpr("filing_id", "concat(last, CASE WHEN filing_id % 2 = 0 THEN ', Jr.' ELSE '' END) AS last", "CASE filing_id % 4 WHEN 0 THEN 'Annabel' WHEN 1 THEN 'Bert' WHEN 2 THEN 'CARLA' ELSE 'Dora' END AS first")
    return resolve.resolve_upper(signer, person, "filing_id")
