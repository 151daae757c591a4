"""Landed documents and folders, rule tables, distributed ranks, bit sets: edge cases and plans."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import core, events, people, resolve, rules, trades, votes
from quorumlake.sources import feeds, landing, xml


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def measured(df):
    """The plan as it ran, with each join's count of rows."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        if "Join" in name:
            out.append(f"{name} number of output rows: {p.metrics().apply('numOutputRows').value()}")
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return "\n".join(out)


def test_house_rolls(spark):
    meta = "<vote-metadata><legis-num>S 5</legis-num><vote-question>On &amp; <![CDATA[a<b]]></vote-question><vote-result>Passed</vote-result><action-date>3-Jan-2025</action-date><vote-totals><totals-by-party><yea-total>9</yea-total></totals-by-party><totals-by-vote><yea-total>7</yea-total><nay-total>2</nay-total><present-total>1</present-total></totals-by-vote></vote-totals></vote-metadata>"
    data = '<vote-data><recorded-vote><legislator name-id="A1" party="R">Abe</legislator><vote>Aye</vote></recorded-vote><recorded-vote><legislator name-id="B1"/><vote>Not Voting</vote></recorded-vote></vote-data>'
    quorum = "<rollcall-vote><vote-metadata><vote-question>Call by States</vote-question></vote-metadata>" + data + "</rollcall-vote>"
    docs = [(2025, 1, f"<rollcall-vote>{meta}{data}</rollcall-vote>"), (2025, 2, quorum), (2025, 3, "<rollcall-vote><vote-metadata>"), (2025, 4, None), (2025, 5, "<rollcall-vote><vote-metadata><action-date>x</action-date></vote-metadata></rollcall-vote>")]
    ballots, positions, rejected = xml.house_rolls(spark.createDataFrame(docs, "year int, roll int, xml string"), 119)
    got = {r.vote_id: r for r in ballots.collect()}
    one = got["house-119-2025-1"]
    assert (str(one.ballot_date), one.question, one.item_id, one.yeas, one.nays, one.present, one.not_voting) == ("2025-01-03", "On & a<b", "s-5-119", 7, 2, 1, 0)
    assert got.keys() == {"house-119-2025-1", "house-119-2025-5"} and str(got["house-119-2025-5"].ballot_date) == "2025-01-01"
    assert rows(positions) == [("house-119-2025-1", "A1", "yea"), ("house-119-2025-1", "B1", "not_voting")]
    assert sorted((r.roll, r.xml) for r in rejected.collect() if r.xml) == [(3, "<rollcall-vote><vote-metadata>")] and rejected.count() == 2


def test_senate_rolls(spark):
    doc = "<roll_call_vote><vote_date>January 9, 2025,  02:54 PM</vote_date><question>Q</question><vote_title></vote_title><document><document_type>H.J.Res.</document_type><document_number>3</document_number></document><count><yeas>51</yeas><nays/></count><members><member><last_name>KING </last_name><state>ME</state><vote_cast>Yea</vote_cast></member><member><last_name>Nobody</last_name><state>ME</state><vote_cast>Nay</vote_cast></member></members></roll_call_vote>"
    lookup = spark.createDataFrame([("u1", "King", "ME", 1), ("u2", "King", "ME", 2)], "entity_id string, last_name string, state string, seat int")
    ballots, positions, rejected = xml.senate_rolls(spark.createDataFrame([(2025, 7, doc)], "year int, roll int, xml string"), lookup, [F.desc("seat")], 119)
    b = ballots.first()
    assert (b.vote_id, str(b.ballot_date), b.description, b.item_id, b.yeas, b.nays) == ("senate-119-2025-7", "2025-01-09", None, "hjres-3-119", 51, 0)
    assert rows(positions) == [("senate-119-2025-7", "u2", "yea")] and rejected.count() == 0


def test_html_amounts(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    page = '<table class="table"><tr><th>h</th></tr>' + row(1, "1/2/2024", "Spouse", "BA", "Boeing", "Stock", "Purchase", "$15,001 -  $50,000", "Capital gains over $200") + row(2, "", "", "--", " ", "Stock", "Sale", "x", "") + row(3, "bad", "Self", "--", "Bond X", "Muni", "Sale (Full)", "over $50,000,000") + "</table>"
    got = feeds.parse_html_trades(spark.createDataFrame([(1, page)], "id int, html string"), "id").orderBy("row_index").collect()
    assert [(r.row_index, r.ticker, r.amount_range, r.amount_min, r.amount_max, r.cap_gains, r.confidence) for r in got] == [(0, "BA", "$15,001 - $50,000", 15001, 50000, True, 95), (1, None, "Over $50,000,000", 50000001, None, False, 85)]


def test_incremental_scan_reads_only_new_folders(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, id) AS ts FROM range(10)").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    log = "source string, completed_at timestamp, status string, records_count long"
    runs = spark.sql("SELECT 'a' AS source, timestamp'2024-01-09 00:00:00' AS completed_at, 'success' AS status, 5L AS records_count UNION ALL SELECT 'a', timestamp'2024-01-20 00:00:00', 'failed', 5L UNION ALL SELECT 'a', timestamp'2024-01-21 00:00:00', 'success', 0L")
    for day in range(1, 8):  # a file that cannot be read in every older folder
        for f in Path(path, f"day=2024-01-0{day}").glob("*.parquet"):
            f.write_bytes(b"broken")
    some = landing.changed_since(spark.read.schema("event_id long, ts timestamp, day date").parquet(path), runs, "a", "day", "ts")
    assert [r.event_id for r in some.orderBy("event_id").collect()] == [7, 8, 9]  # from 2024-01-08 00:00 on
    assert "PartitionFilters: [isnotnull(day" in plan(some) and "Subquery" in plan(some)
    with pytest.raises(Exception, match="(?i)parquet|corrupt|footer"):  # without a run all is read
        landing.changed_since(spark.read.schema("event_id long, ts timestamp, day date").parquet(path), spark.createDataFrame([], log), "a", "day", "ts").collect()


def test_rejects_are_split_in_one_pass(spark, tmp_path):
    line = spark.createDataFrame([("P", "$1,001 - $15,000", "2024-01-01", "ok", 1), ("X", "?", "1/1/24", "", 2), (None, None, None, None, 3)], "tx_type string, amount_range string, tx_date string, asset_description string, errors_ int")
    valid, rejected, seen = landing.split_rejects(line, trades.line_errors(), str(tmp_path / "out"))
    assert seen == {"rows": 3, "valid": 1, "rejected": 2} and rows(valid) == [("P", "$1,001 - $15,000", "2024-01-01", "ok", 1)]
    assert sorted(len(r.errors) for r in rejected.collect()) == [3, 4]
    assert "verdict" in plan(valid) and "PartitionFilters: [isnotnull(verdict" in plan(valid)


def test_orphan_files_are_listed_without_reading(spark, tmp_path):
    for name in ("doc=a", "doc=b", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bin").write_bytes(b"12")
    files = landing.listing(spark, str(tmp_path), "*.bin")
    assert files.count() == 3 and "ReadSchema: struct<path:string" in plan(files.select("path", "length")).replace("`", "") and "content" not in plan(files)
    left = landing.orphan_files(files, spark.createDataFrame([("a",), (None,)], "doc string"), "doc", r"doc=(\w+)/")
    assert sorted((r.doc or "", r.length) for r in left.collect()) == [("", 2), ("b", 2)]


def test_broken_records_are_kept_apart(spark):
    texts = ['{"id":{"bioguide":"B1"},"name":{"first":"A","last":"B"},"bio":{"birthday":"1950-02-30"},"terms":[{"type":"rep","state":"CA","district":3,"url":"https://x"}]}', '{"id":', "[1]", None, "{}", '{"terms":[{"district":"three"}]}']
    good, bad = landing.parse_json(spark.createDataFrame([(t,) for t in texts], "json string"), feeds.PERSON)
    assert sorted(r.record or "" for r in bad.collect()) == sorted(["", '{"id":', "[1]", '{"terms":[{"district":"three"}]}']) and good.count() == 2
    one = feeds.normalize_entities(good).collect()
    assert [(r.entity_id, r.full_name, r.birth_date, r.website_url, r.phone) for r in one] == [("B1", "A B", None, "https://x", None)]


def test_rules_of_every_kind(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 50, "x"), (3, None, None, "xxxx"), (4, "c", 5, None), (5, "c", 5, None)], "id int, kind string, size int, name string")
    table = [
        rules.Rule("r", "required", ("size",)), rules.Rule("a", "accepted", ("kind",), values=("a", "b")), rules.Rule("l", "longest", ("name",), size=3), rules.Rule("b", "between", ("size",), low=1, high=10),
        rules.Rule("u", "unique", ("kind", "size")), rules.Rule("n", "unique", ("name",)), rules.Rule("k", "key", ("kind",), parent=spark.createDataFrame([("a",), ("c",)], "code string"), parent_columns=("code",)),
    ]
    assert rows(rules.check(df, table, ["id"])) == sorted([("r", "3", 1), ("a", "4", 1), ("a", "5", 1), ("l", "3", 1), ("b", "2", 1), ("u", "c/5", 2), ("n", "x", 2), ("k", "2", 1)], key=repr)
    with pytest.raises(ValueError, match="no rule"):
        rules.check(df, [rules.Rule("x", "other", ("id",))], ["id"])


def test_ranks_without_a_whole_key_in_a_task(spark):
    """One key of a third of all rows, null keys, descending order with nulls last; ranges split the hot key."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE id % 50 END AS k", "CASE WHEN id % 11 <> 0 THEN (id * 7919) % 6000 END AS x", "id", "'n' AS other").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = core.ranked(df, ["k"], [F.desc_nulls_last("x"), F.asc("id")], "rank")
        parts = df.repartitionByRange("k", F.desc_nulls_last("x"), "id").withColumn("p", F.spark_partition_id()).where("k = 1").select("p").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, groups = [], {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    for k, own in groups.items():
        own.sort(key=lambda r: (r.x is None, -(r.x or 0), r.id))
        want += [(k, r.x, r.id, "n", i + 1) for i, r in enumerate(own)]
    assert rows(got) == sorted(want, key=repr) and got.columns == [*df.columns, "rank"]
    assert sorted(r.place for r in core.ranked(df, [], [F.asc("id")], "place").collect()) == list(range(1, 6001))
    assert core.ranked(df.limit(0), ["k"], [F.asc("id")], "rank").count() == 0
    assert parts > 1


def test_agreement_by_bits_and_by_ballot(spark):
    rng = random.Random(4)
    position = [(b, e, rng.choice(["yea", "nay", "present"])) for b in range(700) for e in range(12) if rng.random() < 0.9] + [(None, 1, "yea"), (1, None, "yea")]
    df = spark.createDataFrame(position, "ballot_id int, entity_id int, position string")
    by_ballot = rows(votes.pairwise_agreement(df, dense=False))
    assert rows(votes.pairwise_agreement(df, dense=True, block=5)) == by_ballot == rows(votes.pairwise_agreement(df)) and len(by_ballot) == 66
    assert "bit_count" in plan(votes.pairwise_agreement(df)) and "bit_count" not in plan(votes.pairwise_agreement(df.where("entity_id = ballot_id % 12")))
    assert votes.pairwise_agreement(df.limit(0)).count() == 0


def test_agreement_shuffles_no_pairs(spark):
    rng = random.Random(5)
    position = [(b, e, rng.choice(["yea", "nay", "present"])) for b in range(1200) for e in range(14) if rng.random() < 0.8] + [(None, 1, "yea"), (1, None, "yea")]
    df = spark.createDataFrame(position, "ballot_id int, entity_id int, position string")
    shared, agreed = Counter(), Counter()
    for b in range(1200):
        cast = [(e, v) for ballot, e, v in position if ballot == b and e is not None and v != "present"]
        for (a, va), (c, vc) in combinations(sorted(cast), 2):
            shared[a, c] += 1
            agreed[a, c] += va == vc
    want = sorted(((a, b, n, agreed[a, b], int(Fraction(100 * agreed[a, b], n) + Fraction(1, 2))) for (a, b), n in shared.items()), key=repr)
    for some in (1024, 1200):  # ballots of one block of bit sets, and more
        for dense in (True, False):
            got = votes.pairwise_agreement(df.where(f"ballot_id < {some}"), dense=dense, block=5)
            assert not re.search(r"Exchange hashpartitioning\((tile#\d+, )?a#", plan(got))
    assert rows(votes.pairwise_agreement(df, dense=True, block=5)) == want == rows(votes.pairwise_agreement(df, dense=False, block=5))


def test_resolution_forms_no_pairs(spark):
    e = spark.range(200).selectExpr("CAST(id AS STRING) AS entity_id", "CAST(id % 2 AS STRING) AS state", "IF(id % 5 < 3, 'Lee', 'Lee-Roy') AS last_name", "CAST(IF(id % 4 = 0, NULL, id) AS INT) AS district", "IF(id = 7, 'senate', 'house') AS chamber")
    s = spark.range(600).selectExpr("IF(id % 100 = 99, NULL, id - id % 7) AS src_id", "CAST(id % 3 AS STRING) AS state", "element_at(array('Lee', 'ROY', 'Lee-Roy, Jr.'), CAST(1 + id % 3 AS INT)) AS last", "CAST(IF(id % 5 = 0, NULL, id % 150) AS INT) AS district")
    last, tokens = (lambda x: x.lower().removesuffix(", jr.")), (lambda x: x.lower().split("-"))
    people, hits = e.collect(), {}
    for r in s.where("src_id IS NOT NULL").collect():
        for p in (p for p in people if p.state == r.state):
            for exact, forms in ((True, [p.last_name.lower()]), (False, tokens(p.last_name))):
                if last(r["last"]) in forms:
                    picks = hits.setdefault(r.src_id, {})
                    for n, holds in (("a", True), ("b", r.district is not None and r.district == p.district), ("c", r.district is None and p.chamber == "senate")):
                        picks.setdefault((n, exact), set()).update([p.entity_id] * holds)

    def answer(k):
        picks = hits.get(k, {})
        return next((min(x) for n in "abc" if len(x := picks.get((n, bool(picks.get(("a", True)))), ())) == 1), None)

    want = sorted(((r.src_id, answer(r.src_id)) for r in s.collect()), key=repr)
    assert {x is None for _, x in want} == {True, False}
    for size in ({}, {"small": 0}):  # names sent to every task, and joined
        got = resolve.resolve_lower(s, e, **size)
        assert rows(got) == want
        largest = max(int(n.replace(",", "")) for n in re.findall(r"rows: ([\d,]+)", measured(got)))
        assert largest <= 600


def test_resolution_is_one_join(spark):
    e = spark.createDataFrame([("s1", "CA", "Sánchez", 38, "house"), ("s2", "DE", "McClain Delaney", 6, "house"), ("s3", "TX", "Green", 9, "house"), ("s4", "TX", "Green", 29, "house"), ("s5", "TX", "Green-Cruz", None, "senate"), ("s6", "WY", "Lee", 1, "house"), ("s7", "WY", "Lee", None, "senate")], "entity_id string, state string, last_name string, district int, chamber string")
    s = spark.createDataFrame([(1, "CA", "SANCHEZ, Jr.", 38), (2, "DE", "Delaney", 6), (3, "TX", "Green", 29), (4, "TX", "Green", None), (5, "CA", "Nobody", 1), (6, "TX", "Cruz", None), (7, "WY", "Lee", None), (8, "WY", None, 1)], "src_id int, state string, last string, district int")
    got = resolve.resolve_lower(s, e)
    assert rows(got) == [(1, "s1"), (2, "s2"), (3, "s4"), (4, None), (5, None), (6, "s5"), (7, "s7"), (8, None)]
    assert plan(resolve.resolve_lower(s, e)).count("Join") <= 2  # names, and the sources without a hit


def test_board_is_cut_on_the_map_side(spark):
    cover = spark.range(500).selectExpr("id % 2 AS group_id", "'C' AS committee_id", "'Com' AS name", "concat('N', lpad(id, 4, '0')) AS full_name", "id AS entity_id")
    board = people.committee_board(cover, 3)
    assert "WindowGroupLimit" in plan(board)
    assert [(r.group_id, r.members, r.more) for r in board.orderBy("group_id").collect()] == [(0, "N0000; N0002; N0004", 247), (1, "N0001; N0003; N0005", 247)]


def test_group_activity_mixes_items_and_ballots(spark):
    entity = spark.createDataFrame([(1, 10, "Ann"), (2, 10, "Bo"), (3, 20, "Cy")], "entity_id int, group_id int, full_name string")
    link = spark.createDataFrame([(5, 1, "sponsor"), (6, 2, "cosponsor")], "item_id int, entity_id int, role string")
    item = spark.sql("SELECT 5 AS item_id, 'hr' AS item_type, date'2024-02-01' AS introduced_date UNION ALL SELECT 6, 's', date'2024-02-02'")
    ballot = spark.sql("SELECT 1 AS ballot_id, date'2024-03-01' AS ballot_date, 'v1' AS related_id, 'senate' AS chamber, 'X' AS subject")
    position = spark.createDataFrame([(1, 1, "yea"), (1, 2, "nay"), (1, 3, "nay")], "ballot_id int, entity_id int, position string")
    both = events.item_events(link, item, entity).unionByName(events.ballot_events(ballot, position, entity))
    assert [(r.group_id, r.rank, r.title) for r in events.group_activity(both).orderBy("group_id", "rank").collect()] == [(10, 1, "Senate vote: 1 Yea, 1 Nay on X"), (10, 2, "Ann introduced HR 5"), (20, 1, "Senate vote: delegation voted unanimously Nay on X")]
