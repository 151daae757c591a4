"""Landed records to rows: nested JSON, XML, feeds, HTML tables. Explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

PERSON = "id STRUCT<bioguide: STRING, fec: ARRAY<STRING>>, name STRUCT<first: STRING, last: STRING, official_full: STRING>, bio STRUCT<birthday: STRING, gender: STRING>, terms ARRAY<STRUCT<type: STRING, start: STRING, `end`: STRING, state: STRING, district: INT, party: STRING, url: STRING, contact_form: STRING, phone: STRING>>"

BILL = "type STRING, number STRING, title STRING, introducedDate STRING, latestAction STRUCT<actionDate: STRING, text: STRING>, policyArea STRUCT<name: STRING>, sponsors ARRAY<STRUCT<bioguideId: STRING>>, cosponsors ARRAY<STRUCT<bioguideId: STRING, sponsorshipDate: STRING>>"


def parse_json(raw: DataFrame, schema: str, col: str = "json") -> DataFrame:
    """One row a text; texts that are no such record are dropped."""
    return raw.select(F.from_json(col, schema).alias("r")).where("r IS NOT NULL").select("r.*")


def normalize_entities(persons: DataFrame) -> DataFrame:
    """The flat entity row: its last term is the current one; persons without terms are skipped, empty texts are null."""
    now = F.try_element_at("terms", F.lit(-1))
    text = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(text(F.col("name.official_full")), F.concat_ws(" ", "name.first", "name.last"))
    return persons.where(F.size("terms") > 0).select(
        F.col("id.bioguide").alias("entity_id"), name.alias("full_name"), F.col("name.first").alias("first_name"), F.col("name.last").alias("last_name"), S.norm_party(now["party"]).alias("party"), now["state"].alias("state"),
        S.chamber_from_type(now["type"]).alias("chamber"), now["district"].alias("district"), text(F.col("bio.birthday")).try_cast("date").alias("birth_date"), text(F.col("bio.gender")).alias("gender"),
        text(now["url"]).alias("website_url"), text(now["contact_form"]).alias("contact_form"), text(now["phone"]).alias("phone"), F.try_element_at("id.fec", F.lit(1)).alias("fec_id"),
    )


def explode_terms(persons: DataFrame) -> DataFrame:
    return persons.select(F.col("id.bioguide").alias("entity_id"), F.size("terms").alias("n"), F.posexplode("terms").alias("pos", "t")).select("entity_id", F.col("t.start").alias("start_date"), F.col("t.end").alias("end_date"), F.col("t.party").alias("party"), (F.col("pos") == F.col("n") - 1).alias("is_current"))


def flatten_tree(committees: DataFrame, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Committees (ids, name, subcommittees array<struct<id, name>>) to rows (id, name, parent_id).

    The id is the first of ``ids`` that is neither null nor empty; committees without
    one are dropped with their children. A child's id is its parent's and its own.
    """
    known = committees.withColumn("_id", F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids))).where("_id IS NOT NULL")
    top = known.select(F.col("_id").alias("id"), "name", F.lit(None).cast("string").alias("parent_id"))
    child = known.select("_id", F.explode("subcommittees").alias("s")).select(F.concat("_id", "s.id").alias("id"), F.col("s.name").alias("name"), F.col("_id").alias("parent_id"))
    return top.union(child)


def explode_membership(membership: DataFrame, col: str = "members") -> DataFrame:
    """A map of committee to member structs (bioguide, title) to rows; members without an id are dropped."""
    return membership.select(F.explode(col).alias("committee_id", "list")).select("committee_id", F.inline("list")).where("bioguide IS NOT NULL").select("committee_id", F.col("bioguide").alias("entity_id"), S.norm_role(F.col("title")).alias("role"))


def normalize_items(bills: DataFrame, tracked: DataFrame, congress: int) -> DataFrame:
    """Bill records with their ``item_id`` (type-number-congress), kept where a tracked entity sponsors them."""
    rows = bills.withColumn("item_id", F.concat(F.lower("type"), F.lit("-"), "number", F.lit(f"-{congress}")))
    ours = rows.select("item_id", F.explode("sponsors.bioguideId").alias("entity_id")).join(tracked, "entity_id", "left_semi")
    flat = {"item_type": F.lower("type"), "introduced_date": F.col("introducedDate").try_cast("date"), "latest_action_date": F.col("latestAction.actionDate").try_cast("date"), "latest_action_text": F.col("latestAction.text"), "policy_area": F.col("policyArea.name")}
    return rows.join(ours.select("item_id"), "item_id", "left_semi").withColumns(flat)


def explode_sponsorships(items: DataFrame, tracked: DataFrame) -> DataFrame:
    """(item_id, entity_id, role, cosponsored_date) of tracked entities; of repeated links the one with the earliest date stays."""
    sponsor = items.select("item_id", F.explode("sponsors.bioguideId").alias("entity_id"), F.lit("sponsor").alias("role"), F.lit(None).cast("date").alias("cosponsored_date"))
    other = items.select("item_id", F.explode("cosponsors").alias("c")).select("item_id", F.col("c.bioguideId").alias("entity_id"), F.lit("cosponsor").alias("role"), F.col("c.sponsorshipDate").try_cast("date").alias("cosponsored_date"))
    ours = sponsor.unionByName(other).join(tracked, "entity_id", "left_semi")
    return ours.groupBy("item_id", "entity_id", "role").agg(F.min("cosponsored_date").alias("cosponsored_date"))


def parse_feed_items(raw: DataFrame, key: str, col: str = "xml") -> DataFrame:
    """RSS items, and Atom entries only where a feed has no usable item: (key, title, url, published, description).

    Items without a title or an http link are dropped.
    """

    def entries(kind: str, links: list[str], dates: list[str], texts: list[str]):
        def entry(x):
            tag = lambda name: F.nullif(S.xml_tag(x, name), F.lit(""))
            href = F.nullif(F.regexp_extract(x, r'<link[^>]*href="([^"]*)"', 1), F.lit(""))
            url = F.coalesce(*(href if name == "href" else tag(name) for name in links))
            return F.struct(F.substring(S.html_text(tag("title")), 1, 1000).alias("title"), F.substring(url, 1, 2000).alias("url"), S.parse_feed_date(F.coalesce(*map(tag, dates))).alias("published"), F.substring(S.html_text(F.coalesce(*map(tag, texts))), 1, 500).alias("description"))

        found = F.regexp_extract_all(col, F.lit(rf"(?s)<{kind}[ >].*?</{kind}>"), F.lit(0))
        return F.filter(F.transform(found, entry), lambda e: (e["title"] != "") & e["url"].startswith("http"))

    items = entries("item", ["link", "guid"], ["pubDate", "dc:date", "published"], ["description", "content:encoded"])
    atom = entries("entry", ["href", "link"], ["published", "updated"], ["summary", "content"])
    both = raw.select(key, items.alias("items"), atom.alias("entries"))
    return both.select(key, F.inline(F.when(F.size("items") > 0, F.col("items")).otherwise(F.col("entries"))))


def parse_html_trades(raw: DataFrame, key: str, col: str = "html") -> DataFrame:
    """Rows of the first table of class ``table``; kept rows are numbered from 0.

    Header rows, rows under eight cells and rows without a description are skipped. The
    amount's cell becomes the range that it names, with its bounds. A row is surer of
    itself with a ticker (95) than without (85).
    """
    table = F.regexp_extract(col, r'(?s)<table[^>]*class="[^"]*\btable\b[^"]*"[^>]*>(.*?)</table>', 1)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>")), S.html_text)
    rows = F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>")), cells), lambda c: (F.size(c) >= 8) & (F.trim(F.get(c, F.lit(4))) != ""))
    c = lambda i: F.get("c", F.lit(i))
    ticker, amount = F.when(S.valid_ticker(c(3)), c(3)), S.amount_bucket(c(7))
    return raw.select(key, F.posexplode(rows).alias("row_index", "c")).select(
        key, "row_index", S.parse_us_date(c(1)).alias("tx_date"), S.map_owner(c(2)).alias("owner_code"), ticker.alias("ticker"), c(4).alias("asset_description"), S.map_asset_type(c(5)).alias("asset_type"), S.map_tx_type(c(6)).alias("tx_type"),
        amount["label"].alias("amount_range"), amount["low"].alias("amount_min"), amount["high"].alias("amount_max"), F.coalesce(F.contains(F.lower(c(8)), F.lit("capital gains")), F.lit(False)).alias("cap_gains"), F.when(ticker.isNotNull(), 95).otherwise(85).alias("confidence"),
    )


def content_hash(files: DataFrame, col: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(col).cast("binary"), 256))


def join_social(entities: DataFrame, social: DataFrame, order: list) -> DataFrame:
    """Entities with the accounts of a side table; of repeated ids its last row in ``order`` counts."""
    last = F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))
    return entities.join(social.withColumn("_n", last).where("_n = 1").drop("_n"), "entity_id", "left")


def ingest_finance(feed: DataFrame, measures: list[str]) -> DataFrame:
    """Feed rows with a cycle; measures become whole dollars, nulls 0."""
    return feed.where("cycle IS NOT NULL AND cycle <> 0").withColumns({m: F.round(F.coalesce(m, F.lit(0.0))).cast("long") for m in measures})
