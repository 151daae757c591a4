import pytest
from pyspark.sql import functions as F

from quorumlake.operators import core, people, resolve, text, trades, votes
from quorumlake.sources import feeds
from quorumlake.sources import xml as xml_docs
from quorumlake.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_is_idempotent_and_partial(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    s = spark.createDataFrame([(2, "new", 20), (2, "newer", 21), (3, "c", 3)], "k int, x string, y int")
    once = core.upsert(t, s, ["k"], ["y"], [F.desc("y")])
    assert rows(once) == [(1, "a", 1), (2, "b", 21), (3, "c", 3)]
    assert rows(core.upsert(once, s, ["k"], ["y"], [F.desc("y")])) == rows(once)
    kept = core.insert_ignore(t, s, ["k"], [F.asc("y")])
    assert rows(kept) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    empty = s.limit(0)
    assert rows(core.upsert(t, empty, ["k"], ["y"], [F.desc("y")])) == rows(t)


def test_guards_and_splits(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "k int")
    good, bad = core.fk_guard(child, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert rows(good) == [(1,)] and rows(bad) == [(9,), (None,)]
    line = spark.createDataFrame([("P", "$1,001 - $15,000", "2024-01-01", "ok"), ("X", "?", "1/1/24", "")], "tx_type string, amount_range string, tx_date string, asset_description string")
    valid, rejected = core.split_valid(line, trades.line_errors())
    assert valid.count() == 1 and len(rejected.first().errors) == 4


def test_agreement_is_one_row_a_pair(spark):
    p = spark.createDataFrame([(1, 1, "yea"), (1, 2, "yea"), (2, 1, "nay"), (2, 2, "yea"), (3, 1, "present"), (3, 2, "yea")], "ballot_id int, entity_id int, position string")
    assert rows(votes.pairwise_agreement(p)) == [(1, 2, 2, 1, 50)]
    assert rows(votes.pairwise_agreement(p.limit(0))) == []


def test_breakdown_sums_to_members(spark):
    g = spark.createDataFrame([(1, "A"), (2, "B")], "group_id int, name string")
    e = spark.createDataFrame([(1, 1, "Democrat", True), (2, 1, "Green", True), (3, 1, "Republican", False)], "entity_id int, group_id int, party string, in_office boolean")
    b = people.category_breakdown(g, e)
    assert rows(b) == [(1, "A", 2, 1, 0, 1), (2, "B", 0, 0, 0, 0)]
    assert {r.dominance for r in people.party_share(b).collect()} == {"split", "none"}


def test_keywords_phrases_first(spark):
    t = spark.createDataFrame([("s", "Climate change and climate policy"), ("s", "policy on climate change"), ("s", None)], "source string, title string")
    got = [(r.term, r.n, r.is_phrase) for r in text.keywords(t, "source").orderBy("rank").collect()]
    assert got == [("climate change", 2, True), ("policy", 2, False)]


def test_resolution_cascade(spark):
    e = spark.createDataFrame([("s1", "CA", "Sánchez", "Linda", 38, "house"), ("s2", "DE", "McClain Delaney", "April", 6, "house"), ("s3", "TX", "Green", "Al", 9, "house"), ("s4", "TX", "Green", "Gene", 29, "house"), ("u1", "ME", "King", "Angus", None, "senate")], "entity_id string, state string, last_name string, first_name string, district int, chamber string")
    s = spark.createDataFrame([(1, "CA", "Sanchez", 38), (2, "DE", "Delaney", 6), (3, "TX", "Green", 29), (4, "TX", "Green", None), (5, "CA", "Nobody", 1)], "src_id int, state string, last string, district int")
    assert rows(resolve.resolve_lower(s, e)) == [(1, "s1"), (2, "s2"), (3, "s4"), (4, None), (5, None)]
    u = spark.createDataFrame([(1, "Angus", "King, Jr.")], "src_id int, first string, last string")
    assert rows(resolve.resolve_upper(u, e)) == [(1, "u1")]


def test_feeds(spark):
    xml = spark.createDataFrame([(1, "<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x/1</link><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item><item><title>no link</title></item></rss>"), (2, "<feed><entry><title>E</title><link href=\"http://x/2\"/><published>2025-01-06T10:00:00Z</published></entry></feed>"), (3, None), (4, "")], "id int, xml string")
    got = feeds.parse_feed_items(xml, "id").orderBy("id").collect()
    assert [(r.id, r.title, r.url, str(r.published)) for r in got] == [(1, "A & B", "https://x/1", "2025-01-06 10:00:00"), (2, "E", "http://x/2", "2025-01-06 10:00:00")]
    m = xml_docs.manifest(spark.createDataFrame([("<Index><Member><DocID>7</DocID><Last>King</Last><First>A</First><FilingDate>1/2/2024</FilingDate><StateDst>CA11</StateDst></Member></Index>",)], "xml string"))[0].first()
    assert (m.doc_id, str(m.filed_date), m.state, m.district) == ("7", "2024-01-02", "CA", 11)
    persons = feeds.parse_json(spark.createDataFrame([('{"id":{"bioguide":"B1","fec":["F1"]},"name":{"first":"A","last":"B"},"terms":[{"type":"rep","party":"Libertarian","state":"CA","district":3},{"type":"sen","party":"Libertarian","state":"CA"}]}',), ("{}",)], "json string"), feeds.PERSON)
    assert rows(feeds.normalize_entities(persons).select("entity_id", "full_name", "party", "state", "chamber", "district", "fec_id")) == [("B1", "A B", "Independent", "CA", "senate", None, "F1")]
    assert [r.is_current for r in feeds.explode_terms(persons.where("id is not null")).orderBy("is_current").collect()] == [False, True]
    tree = spark.createDataFrame([("HA", "Ag", [("01", "Sub")])], "id string, name string, subcommittees array<struct<id: string, name: string>>")
    assert rows(feeds.flatten_tree(tree)) == [("HA", "Ag", None), ("HA01", "Sub", "HA")]
    member = spark.createDataFrame([({"HA": [("B1", "Chairman"), (None, None)]},)], "members map<string, array<struct<bioguide: string, title: string>>>")
    assert rows(feeds.explode_membership(member)) == [("HA", "B1", "chair")]


def test_streams(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "table")
    jobs.create_table(spark.createDataFrame([(1, 1), (7, 7)], "k int, y int"), path, ["k"], 8)
    untouched = {f for f in (tmp_path / "table").rglob("*.parquet") if spark.read.parquet(str(f)).where("k = 7").count()}
    spark.createDataFrame([(1, 5), (2, 6)], "k int, y int").write.parquet(src)
    stream = spark.readStream.schema("k int, y int").parquet(src)
    jobs.stream_upsert(stream, path, ["k"], ["y"], [F.desc("y")], str(tmp_path / "c"), 8).awaitTermination(60)
    assert rows(jobs.read_table(spark, path)) == [(1, 5), (2, 6), (7, 7)]
    same = spark.range(8).select(F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(8)).alias("b"), "id").where("id in (1, 2, 7)").collect()
    if len({r.b for r in same}) == 3:
        assert all(f.exists() for f in untouched)  # its folder was not written again
    spark.createDataFrame([(1, 9), (3, 3)], "k int, y int").write.mode("append").parquet(src)
    jobs.stream_upsert(stream, path, ["k"], None, [F.desc("y")], str(tmp_path / "i"), 8).awaitTermination(60)
    assert rows(jobs.read_table(spark, path)) == [(1, 5), (2, 6), (3, 3), (7, 7)]
    ev = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-02-02 00:00:00", "b")], "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type").write.parquet(ev)
    q = jobs.daily_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(ev)).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(jobs.monthly_from_daily(spark.table("daily"))) == [("2024-01", "a", 2), ("2024-02", "b", 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    """Append mode: a day comes out once the watermark has passed it; later rows of it don't count."""
    ev, out = tmp_path / "ev", str(tmp_path / "out")
    stamp = lambda *times: spark.createDataFrame([(t, "a") for t in times], "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type").coalesce(1)

    def run():
        q = jobs.daily_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(ev))).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    stamp("2024-01-01 01:00:00", "2024-01-01 05:00:00").write.parquet(str(ev))
    run()
    stamp("2024-01-10 00:00:00").write.mode("append").parquet(str(ev))
    run()
    stamp("2024-01-01 06:00:00", "2024-01-20 00:00:00").write.mode("append").parquet(str(ev))  # the first is too late
    run()
    got = {(str(r.day), r.n) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01", 2) in got and not any(d == "2024-01-01" and n != 2 for d, n in got) and ("2024-01-10", 1) in got


def test_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    t = spark.range(100).selectExpr("id % 5 AS k", "id")
    assert "WindowGroupLimit" in plan(core.topk_per_key(t, ["k"], [F.desc("id")], 2))
    assert "LeftAnti" in plan(core.only_new(t, t.limit(3), ["k"]))


@pytest.mark.parametrize("name", ["pairwise_agreement", "trade_summary", "keywords", "html_trades_round_trip", "upsert"])
def test_registered(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_round_trips(spark):
    from quorumlake.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    import __spark_entry__ as entry

    assert entry.queries()["html_trades_round_trip"](spark, "/root/testdata/sf0.001").count() == t.trade.count()
    back = entry.queries()["rollcall_round_trip"](spark, "/root/testdata/sf0.001")
    assert rows(back.selectExpr("ballot_id", "cast(entity_id as long)", "position")) == rows(t.position)


def test_large_ballots_are_dealt_into_blocks(spark):
    rows = [(b, e, "yea" if (b * e) % 3 else "nay") for b in range(3) for e in range(4 + 5 * b)] + [(None, 1, "yea"), (1, None, "yea"), (1, 2, "present")]
    position = spark.createDataFrame(rows, "ballot_id int, entity_id int, position string")
    want = sorted(votes.pairwise_agreement(position).collect())
    assert sorted(votes.pairwise_agreement(position, block=2).collect()) == want
    assert len(want) == 14 * 13 // 2


def test_parts_keep_every_row_and_split_large_keys(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 = 9 THEN NULL ELSE IF(id < 4000, 1, id) END AS k", "id")
    got = core.parts(rows, "k", "id", size=500).groupBy("k", "part").count().collect()
    assert sum(r["count"] for r in got) == 5000
    assert max(r["count"] for r in got if r.k == 1) < 1000 and {r.part for r in got if r.k != 1 and r.k is not None} == {0}
