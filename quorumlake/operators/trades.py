"""Disclosed trades: summaries, tickers, months, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import AMOUNT_RANGES, NOT_TICKERS, valid_ticker
from .core import ranked


def amount_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(AMOUNT_RANGES)], "bucket int, label string, low long, high long")


def bucketed(trade: DataFrame) -> DataFrame:
    """Each trade with the range (bucket, label, low, high) that holds its amount; amounts below the first range belong to it."""
    out = None
    for i, (label, low, high) in enumerate(AMOUNT_RANGES):
        value = F.struct(F.lit(i).alias("bucket"), F.lit(label).alias("label"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
        inside = F.col("amount").isNotNull() if high is None else F.col("amount") <= high
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return trade.withColumn("_b", out).where("_b IS NOT NULL").select(*trade.columns, "_b.*")


def trade_summary(trade: DataFrame, filing: DataFrame) -> DataFrame:
    """Per entity: trades, buys (P), sells (S...), late ones, summed bounds of the ranges, dates, filings (counted apart from the lines).

    Entities with filings but no lines stay, with zeros and null dates.
    """
    lines = bucketed(trade).groupBy("entity_id").agg(F.count("*").alias("trades"), F.count_if(F.col("tx_type") == "P").alias("buys"), F.count_if(F.col("tx_type").startswith("S")).alias("sells"), F.count_if("filed_late").alias("late"), F.sum("low").alias("low"), F.sum(F.coalesce("high", F.lit(0))).alias("high"), F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"))
    both = lines.join(filing.groupBy("entity_id").agg(F.count("*").alias("filings")), "entity_id", "full_outer")
    return both.na.fill(0, ["trades", "buys", "sells", "late", "low", "high", "filings"])


def home_totals(trade: DataFrame, entity: DataFrame, filing: DataFrame) -> DataFrame:
    """One row: trades of known entities, traders by chamber, and all filings, with lines or not."""
    of = lambda chamber: F.count_distinct(F.when(F.col("chamber") == chamber, F.col("entity_id"))).alias(chamber)
    lines = trade.join(entity.select("entity_id", "chamber"), "entity_id").agg(F.count("*").alias("trades"), of("senate"), of("house"))
    return lines.crossJoin(filing.agg(F.count("*").alias("filings")))  # one row each


def totals(trade: DataFrame, filing: DataFrame) -> DataFrame:
    """One row: members, trades, late lines, first and last date, filings and the latest filing."""
    lines = trade.agg(F.count_distinct("entity_id").alias("members"), F.count("*").alias("trades"), F.count_if("filed_late").alias("late"), F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"))
    return lines.crossJoin(filing.agg(F.count("*").alias("filings"), F.max("filed_date").alias("latest_filing")))  # one row each


def member_trades(trade: DataFrame) -> DataFrame:
    """(ticker, entity_id, seq, tx_date, tx_type, filing_id, row_index): each member's trades of a ticker, numbered by date."""
    rows = trade.where("ticker IS NOT NULL").select("ticker", "entity_id", "tx_date", "tx_type", "filing_id", "row_index")
    numbered = ranked(rows, ["ticker", "entity_id"], [F.col("tx_date").asc_nulls_first(), F.asc("filing_id"), F.asc("row_index")], "seq")
    return numbered.select("ticker", "entity_id", "seq", "tx_date", "tx_type", "filing_id", "row_index")


def monthly(trade: DataFrame, entity: DataFrame, as_of: str, months: int = 14) -> DataFrame:
    """Dated trades per month and party over the last months up to ``as_of``; empty months are left out."""
    end = F.to_date(F.lit(as_of))
    rows = trade.where((F.col("tx_date") >= F.add_months(end, -months)) & (F.col("tx_date") <= end)).join(entity.select("entity_id", "party"), "entity_id")
    return rows.groupBy(F.date_format("tx_date", "yyyy-MM").alias("month")).agg(F.count_if(F.col("party") == "Democrat").alias("democrats"), F.count_if(F.col("party") == "Republican").alias("republicans"), F.count_if(~F.col("party").isin("Democrat", "Republican")).alias("others"), F.count("*").alias("total"))


def monthly_buy_sell(trade: DataFrame) -> DataFrame:
    """Per month buys and everything else; all dates."""
    return trade.where("tx_date IS NOT NULL").groupBy(F.date_format("tx_date", "yyyy-MM").alias("month")).agg(F.count_if(F.col("tx_type") == "P").alias("buys"), F.count_if(F.col("tx_type") != "P").alias("sells"))


def ticker_rollup(trade: DataFrame) -> DataFrame:
    return trade.where("ticker IS NOT NULL").groupBy("ticker").agg(F.count_distinct("entity_id").alias("members"), F.count("*").alias("trades"), F.count_if(F.col("tx_type") == "P").alias("buys"), F.count_if(F.col("tx_type") != "P").alias("sells"), F.date_format(F.min("tx_date"), "yyyy-MM").alias("first_month"), F.date_format(F.max("tx_date"), "yyyy-MM").alias("last_month"))


def ticker_holders(trade: DataFrame) -> DataFrame:
    return trade.where("ticker IS NOT NULL").groupBy("ticker", "entity_id").agg(F.count("*").alias("trades"), F.count_if(F.col("tx_type") == "P").alias("buys"), F.count_if(F.col("tx_type").startswith("S")).alias("sells"), F.max("tx_date").alias("latest"))


def month_axis(trade: DataFrame) -> DataFrame:
    """Month ticks over the trades' dates, every 1, 2 or 3 months by span (over 6, over 18 months)."""
    d = trade.agg(F.trunc(F.min("tx_date"), "month").alias("a"), F.trunc(F.max("tx_date"), "month").alias("b"))
    span = F.months_between("b", "a")
    stride = F.when(span > 18, F.expr("INTERVAL 3 MONTH")).when(span > 6, F.expr("INTERVAL 2 MONTH")).otherwise(F.expr("INTERVAL 1 MONTH"))
    return d.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", stride)).alias("tick"))


def log_size(trade: DataFrame, amount=None, base: float = 2.0, scale: float = 6.0) -> DataFrame:
    """Mark size of each trade on its entity's logarithmic range of ``amount`` (a Column, by default ``amount``); ``base`` where the range is empty."""
    x = F.ln(F.greatest(F.col("amount") if amount is None else amount, F.lit(1)))
    rows = trade.select("filing_id", "row_index", "entity_id", x.alias("x"))
    ranges = rows.groupBy("entity_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    size = F.when(F.col("hi") > F.col("lo"), base + scale * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(base)
    return rows.join(ranges, "entity_id").select("filing_id", "row_index", F.round(size, 4).alias("size"))


def header_confidence(filing: DataFrame, trade: DataFrame) -> DataFrame:
    """Headers with the rounded mean confidence of their lines; headers without lines keep theirs."""
    mean = trade.groupBy("filing_id").agg(F.round(F.avg("confidence")).cast("int").alias("_new"))
    return filing.join(mean, "filing_id", "left").withColumn("parse_confidence", F.coalesce("_new", F.col("parse_confidence").cast("int"))).drop("_new")


def enrich_tickers(trade: DataFrame, dimension: DataFrame) -> DataFrame:
    """Null tickers filled from a description dimension (one row a description), if what it gives is a ticker and no listed word.

    A filled line's confidence is at least 85, and its review flag goes if it was below 80.
    """
    d = dimension.where(valid_ticker(F.col("ticker")) & ~F.col("ticker").isin(NOT_TICKERS)).select("asset_description", F.col("ticker").alias("_found"))
    filled = F.col("ticker").isNull() & F.col("_found").isNotNull()
    new = {"needs_review": F.when(filled & (F.col("confidence") < 80), False).otherwise(F.col("needs_review")), "confidence": F.when(filled, F.greatest("confidence", F.lit(85))).otherwise(F.col("confidence")), "ticker": F.coalesce("ticker", "_found")}
    return trade.join(d, "asset_description", "left").withColumns(new).drop("_found")


def repair_tickerless(lines: DataFrame) -> DataFrame:
    """Bonds, options and others without a ticker that are otherwise complete get a confidence of 80 and no review."""
    ok = F.col("ticker").isNull() & (F.col("confidence") < 80) & F.col("asset_type").isin("Bond", "Other", "Option") & F.col("tx_date").isNotNull() & F.col("amount_range").isNotNull() & F.col("tx_type").isin("P", "S", "S (partial)", "E") & (F.length("asset_description") > 5)
    return lines.withColumns({"confidence": F.when(ok, 80).otherwise(F.col("confidence")), "needs_review": F.when(ok, False).otherwise(F.col("needs_review"))})


def clear_blacklisted(lines: DataFrame, words: list[str] = NOT_TICKERS) -> DataFrame:
    return lines.withColumn("ticker", F.when(~F.col("ticker").isin(words), F.col("ticker")))


def suspicious(lines: DataFrame, pattern: str = r"^[^A-Za-z]*$") -> DataFrame:
    """Lines whose description is short or matches ``pattern``, or whose ticker has odd signs."""
    return lines.where((F.length("asset_description") < 12) | F.col("asset_description").rlike(pattern) | F.coalesce(F.col("ticker").rlike(r"[$/-]"), F.lit(False)))


def line_errors():
    """The validation messages of a parsed line, as an array."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("tx_type").isin("P", "S", "S (partial)", "E"), F.lit(False)), "invalid type"),
        F.when(~F.coalesce(F.col("amount_range").isin(*(r[0] for r in AMOUNT_RANGES)), F.lit(False)), "invalid amount range"),
        F.when(F.col("tx_date").isNotNull() & ~F.col("tx_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "malformed date"),
        F.when(F.length(F.trim(F.coalesce("asset_description", F.lit("")))) < 2, "missing description"),
    ))
