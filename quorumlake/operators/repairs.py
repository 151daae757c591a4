"""Parsed lines to filings and trades; repairs of tickers and asset types; samples and time positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trades import amount_dimension, line_errors

# Two-letter asset codes that were taken for tickers, by the repair that clears them.
STOCK_CODES = ["ST", "GS", "CS", "BD", "OP", "MF", "ET", "PS", "OL", "OM", "RE", "PE"]
TAG_CODES = ["CT", "OI", "BA", "DB", "OT", "FU", "PD", "FA", "HE"]
# Bracketed tags and the asset types that they stand for.
TAG_TYPES = {"CT": "Cryptocurrency", "PS": "Stock", "OI": "Other", "RE": "Other"}
# Transaction types of a line; the text of the form's own example row.
TX_TYPES = ["P", "S", "S (partial)", "E"]
TEMPLATE = "example mega corp"


def build_filings(filing: DataFrame, line: DataFrame) -> DataFrame:
    """(filing_id, parse_status, parse_confidence): ``review`` where a line has an error, else ``parsed``.

    Confidence is the lines' mean in whole percent, 0 without lines. The mean is taken
    over exact decimals, so that the order of rows cannot change its rounding.
    """
    percents = F.col("confidence").cast("decimal(9,6)") * 100
    lines = line.groupBy("filing_id").agg(F.sum(percents).alias("sum"), F.count("confidence").alias("n"), F.max(F.size(line_errors()) > 0).alias("bad"))
    mean = F.when(F.col("n") > 0, F.round(F.col("sum").cast("double") / F.col("n"))).otherwise(0).cast("int")
    return filing.select("filing_id").join(lines, "filing_id", "left").select("filing_id", F.when(F.col("bad"), "review").otherwise("parsed").alias("parse_status"), mean.alias("parse_confidence"))


def build_lines(line: DataFrame) -> DataFrame:
    """The stored form of parsed lines: bounds of the range, late and review flags, confidence in whole percent.

    Unknown ranges have null bounds; without a readable date a line is not late.
    """
    bounds = amount_dimension(line.sparkSession).select(F.col("label").alias("amount_range"), F.col("low").alias("amount_min"), F.col("high").alias("amount_max"))
    late = F.coalesce(F.datediff("filed_date", F.try_to_date("tx_date", "yyyy-MM-dd")) > 45, F.lit(False))
    return line.join(F.broadcast(bounds), "amount_range", "left").select("filing_id", "row_index", "amount_min", "amount_max", late.alias("filed_late"), (F.col("confidence") < 0.8).alias("needs_review"), F.round(F.col("confidence") * 100).cast("int").alias("confidence"))


def validate_lines(line: DataFrame) -> DataFrame:
    """(filing_id, row_index, errors) of the lines with errors, joined by semicolons."""
    checked = line.select("filing_id", "row_index", F.array_join(line_errors(), "; ").alias("errors"))
    return checked.where("errors <> ''")


def drop_placeholders(line: DataFrame) -> DataFrame:
    return line.where(F.col("tx_type").isin(TX_TYPES))


def drop_template_rows(line: DataFrame) -> DataFrame:
    """Without the form's example rows; rows without a description stay."""
    return line.where(~F.coalesce(F.contains(F.lower("asset_description"), F.lit(TEMPLATE)), F.lit(False)))


def null_code_tickers(line: DataFrame) -> DataFrame:
    """Codes taken for tickers are cleared on lines of a known type other than stock."""
    code = F.col("ticker").isin(STOCK_CODES) & (F.col("asset_type") != "Stock")
    return line.withColumn("ticker", F.when(code, None).otherwise(F.col("ticker")))


def reclassify_by_tag(line: DataFrame) -> DataFrame:
    """Tag codes taken for tickers are cleared and the type is read from the description's tag; then every typed ``[CT]`` line is cryptocurrency."""
    has = lambda tag: F.contains("asset_description", F.lit(f"[{tag}]"))
    code = F.coalesce(F.col("ticker").isin(TAG_CODES), F.lit(False))
    by_tag = F.col("asset_type")
    for tag, kind in reversed(TAG_TYPES.items()):
        by_tag = F.when(has(tag), kind).otherwise(by_tag)
    kind = F.when(code, by_tag).otherwise(F.col("asset_type"))
    swept = F.when(has("CT") & kind.isNotNull(), TAG_TYPES["CT"]).otherwise(kind)
    return line.withColumns({"asset_type": swept, "ticker": F.when(~code, F.col("ticker"))})


def restore_by_pattern(line: DataFrame, ticker: str = "BA") -> DataFrame:
    """Lines without a ticker whose description has it in brackets get it back."""
    named = F.contains(F.lower("asset_description"), F.lit(f"({ticker.lower()})"))
    return line.withColumn("ticker", F.when(F.col("ticker").isNull() & named, ticker).otherwise(F.col("ticker")))


def time_position(df: DataFrame, date: str, name: str = "pct") -> DataFrame:
    """Where ``date`` lies between the table's first and last date, in percent; a range is a day at least."""
    low, high = (df.agg(f(date)).scalar() for f in (F.min, F.max))
    return df.withColumn(name, 100 * F.datediff(F.col(date), low) / F.greatest(F.datediff(high, low), F.lit(1)))


def random_sample(df: DataFrame, keys: list[str], k: int = 20, seed: int = 0) -> DataFrame:
    """``k`` rows drawn by a seeded hash of their keys: the same rows on every run and any cluster."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys))), *keys).limit(k)
