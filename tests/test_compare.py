from pyspark.sql import functions as F

from quorumlake.operators import compare, repairs
from quorumlake.sources import feeds

LINE = "filing_id int, row_index int, filed_date date, tx_date string, confidence double, asset_description string, ticker string, asset_type string, tx_type string, amount_range string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lines(spark, *values):
    return spark.createDataFrame(list(values), LINE.replace("filed_date date", "filed_date string")).withColumn("filed_date", F.to_date("filed_date"))


def test_repairs(spark):
    one = lambda i, d, t, k: (1, i, "2024-03-01", "2024-01-01", 0.9, d, t, k, "P", "$1,001 - $15,000")
    df = lines(spark, one(0, "Coin [CT]", "CT", "Bond"), one(1, "Gold", "GS", None), one(2, "Gold", "GS", "Bond"), one(3, "Boeing (ba)", None, "Stock"), one(4, "x [CT]", "A", None), one(5, None, None, None))
    pick = lambda d, *c: [tuple(r) for r in d.orderBy("row_index").select(*c).collect()]
    assert pick(repairs.null_code_tickers(df), "ticker") == [("CT",), ("GS",), (None,), (None,), ("A",), (None,)]
    assert pick(repairs.reclassify_by_tag(df), "ticker", "asset_type") == [(None, "Cryptocurrency"), ("GS", None), ("GS", "Bond"), (None, "Stock"), ("A", None), (None, None)]
    assert pick(repairs.restore_by_pattern(df), "ticker")[3:] == [("BA",), ("A",), (None,)]
    assert repairs.drop_template_rows(df).count() == 6


def test_parsed_filings(spark):
    df = lines(spark, (1, 0, "2024-03-01", "2024-01-01", 0.79, "ok", None, None, "P", "Over $50,000,000"), (1, 1, "2024-03-01", None, 0.86, "ok", None, None, "S", "$1,001 - $15,000"), (2, 0, "2024-03-01", "1/1/24", 0.5, "", None, None, "?", None))
    filing = spark.createDataFrame([(1,), (2,), (3,)], "filing_id int")
    assert rows(repairs.build_filings(filing, df)) == [(1, "parsed", 83), (2, "review", 50), (3, "parsed", 0)]
    assert rows(repairs.build_lines(df)) == [(1, 0, 50000001, None, True, True, 79), (1, 1, 1001, 15000, False, False, 86), (2, 0, None, None, False, True, 50)]


def test_sample_repeats_and_positions_end_at_100(spark):
    df = spark.range(100).withColumn("d", F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")))
    assert rows(repairs.random_sample(df, ["id"], 5)) == rows(repairs.random_sample(df.repartition(7), ["id"], 5))
    assert repairs.time_position(df, "d").agg(F.min("pct"), F.max("pct")).first()[:] == (0.0, 100.0)
    assert rows(repairs.time_position(df.limit(0), "d")) == []


def test_agreement_of_given_pairs(spark):
    p = spark.createDataFrame([(1, 1, "yea"), (1, 2, "yea"), (1, 3, "yea"), (2, 1, "nay"), (2, 2, "yea")], "ballot_id int, entity_id int, position string")
    assert rows(compare.agreement_of(spark.createDataFrame([(1, 2), (1, 2), (2, 9)], "a int, b int"), p)) == [(1, 2, 2, 1, 50)]


def test_items_need_a_tracked_sponsor(spark):
    raw = spark.createDataFrame([('{"type":"HR","number":"1","sponsors":[{"bioguideId":"A"}],"cosponsors":[{"bioguideId":"B","sponsorshipDate":"2025-02-01"},{"bioguideId":"Z"}]}',), ('{"type":"S","number":"2","sponsors":[{"bioguideId":"Z"}]}',)], "json string")
    tracked = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    items = feeds.normalize_items(feeds.parse_json(raw, feeds.BILL), tracked, 119)
    assert [r.item_id for r in items.collect()] == ["hr-1-119"]
    assert [(r.entity_id, r.role, str(r.cosponsored_date)) for r in feeds.explode_sponsorships(items, tracked).orderBy("entity_id").collect()] == [("A", "sponsor", "None"), ("B", "cosponsor", "2025-02-01")]


def test_brief_is_put_together_piece_by_piece(spark):
    g = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "group_id int, name string")
    # group 1 has many leaders and namesakes, 2 one, 3 none; 4 has no name
    people = [(i, f"N{i % 40:02d}", 1) for i in range(60)] + [(60, "Solo", 2), (61, "None", 3), (62, "Lost", 4)]
    e = spark.createDataFrame([(i, n, k, True, "house", "Democrat") for i, n, k in people], "entity_id int, full_name string, group_id int, in_office boolean, chamber string, party string")
    names = {"X": "Ways", "Y": "Arms", "Z": "Maps"}
    seats = [(i, c, compare.LEADERS[(i + ord(c)) % 3] if (i + ord(c)) % 4 else "member") for i in range(60) for c in names] + [(60, "X", "vice_chair"), (61, "X", "member"), (62, "X", "chair")]
    a = spark.createDataFrame(seats, "entity_id int, committee_id string, role string")
    c = spark.createDataFrame([(k, n, None) for k, n in names.items()] + [("XX", "Sub", "X")], "committee_id string, name string, parent_id string")
    none = spark.createDataFrame([], "entity_id int, role string, cycle int, total_receipts long, total_individual long, total_pac long, small_individual long, position string")
    led = {k: sorted((n, names[x], role) for i, n, own in people if own == k for j, x, role in seats if j == i and role != "member") for k in (1, 2, 3)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_a_batch in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
            df = compare.delegation_brief(g, e, none, none, none, a, c, "2001-06-30")
            got = {r.group_id: r for r in df.collect()}
            assert got.keys() == {1, 2, 3} and {k: r.leadership for k, r in got.items()} == {k: len(x) for k, x in led.items()}
            for k, r in got.items():
                duties = "; ".join(f"{n} ({role.replace('_', ' ')} of {x})" for n, x, role in led[k])
                n = len([1 for *_, own in people if own == k])
                want = f"{'ABC'[k - 1]}'s delegation has 0 senators and {n} representative{'s' * (n > 1)}, majority Democrat ({n}D-0R)."
                want += f" Committee leadership: {duties}." * bool(duties) + f" The delegation holds {180 if k == 1 else 1} committee and subcommittee assignments."
                assert r.summary == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "collect_list(struct(full_name" not in df._jdf.queryExecution().executedPlan().toString()  # no aggregation holds a group's roles
    assert {r.group_id: r.stats for r in compare.delegation_stats(g, e, none, none, none, a, c).collect()} == {k: r.stats for k, r in got.items()}


def test_a_brief_is_done_before_the_next_begins():
    import pyarrow as pa

    row = lambda k, first, duties: {"group_id": k, "first": first, "duties": duties, "head": "H: ", "tail": ".", "plain": "P"}
    read = []

    def batches():
        for rows in ([row(1, True, None), row(1, False, "a")], [row(1, False, "b"), row(2, True, None)], [row(3, True, None), row(3, False, ""), row(3, False, "c")]):
            read.append(len(rows))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("group_id", pa.int32()), ("first", pa.bool_()), *((x, pa.string()) for x in ("duties", "head", "tail", "plain"))]))

    out = compare._written(["group_id"])(batches())
    assert next(out).to_pylist() == [{"group_id": 1, "summary": "H: a; b."}] and len(read) == 2
    assert [x.to_pylist() for x in out] == [[{"group_id": 2, "summary": "P"}], [{"group_id": 3, "summary": "H: c."}]]
