import datetime

from pyspark.sql import functions as F

from quorumlake.functions import scalar as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column.alias("x")).first().x


def test_dates(spark):
    assert one(spark, S.parse_us_date(F.col("d")), d="3/7/24") == datetime.date(2024, 3, 7)
    assert one(spark, S.parse_us_date(F.col("d")), d="13/7/2024") is None
    assert one(spark, S.parse_us_date(F.col("d")), d="no date") is None
    assert one(spark, S.parse_ballot_date(F.col("d")), d="3-Jan-2025") == datetime.date(2025, 1, 3)
    assert one(spark, S.parse_ballot_date(F.col("d")), d="January 9, 2025,  02:54 PM") == datetime.date(2025, 1, 9)
    assert one(spark, S.parse_feed_date(F.col("d")), d="Mon, 06 Jan 2025 10:00:00 GMT") == datetime.datetime(2025, 1, 6, 10)
    assert one(spark, S.parse_feed_date(F.col("d")), d="soon") is None


def test_names_and_tickers(spark):
    assert one(spark, S.fold_name(F.col("n")), n="Sánchez") == "sanchez"
    assert one(spark, S.strip_suffix(F.col("n")), n="King, Jr.") == "King"
    assert one(spark, S.strip_suffix(F.col("n")), n="Hagerty, IV") == "Hagerty"
    none = F.lit(None).cast("string")
    assert one(spark, S.clean_ticker(none, F.col("d")), d="WALT DISNEY COMPANY (THE) CMN") is None
    assert one(spark, S.clean_ticker(none, F.col("d")), d="Boeing (BA) [ST]") == "BA"
    assert one(spark, S.clean_ticker(F.col("t"), F.col("d")), t="CT", d="usdc [CT]") is None
    assert one(spark, S.item_from_text(F.col("d"), F.lit(119)), d="H J RES 3") == "hjres-3-119"
    assert one(spark, S.item_from_text(F.col("d"), F.lit(119)), d="On Passage") is None


def test_markup_and_money(spark):
    assert one(spark, S.html_text(F.col("d")), d="<b>A&amp;B</b>\n &lt;x&gt;") == "A&B <x>"
    assert one(spark, S.xml_tag(F.col("d"), "t"), d="<t a='1'><![CDATA[ hi ]]></t>") == "hi"
    assert [one(spark, S.fmt_money(F.col("m")), m=m) for m in (0, 999, 1500, 999_999, 1_450_000)] == ["$0", "$999", "$2K", "$1000K", "$1.5M"]
    assert [one(spark, S.map_tx_type(F.col("m")), m=m) for m in ("Sale (Partial)", "Purchase", "Exchange", "Sale (Full)")] == ["S (partial)", "P", "E", "S"]
