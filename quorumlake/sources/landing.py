"""Landed folders: a place that all machines share, file listings, tables laid out by date, rejects beside the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.core import folder, incremental_since  # noqa: F401: the place is asked for here too


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified): the files under ``path``; nothing in them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def orphan_files(files: DataFrame, known: DataFrame, key: str, pattern: str) -> DataFrame:
    """Listed files (path) whose ``key``, the first group of ``pattern`` in the path, ``known`` lacks; files without one are orphans too."""
    keyed = files.withColumn(key, F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")))
    return keyed.join(known.select(F.col(key).cast("string").alias(key)), key, "left_anti")


def changed_since(rows: DataFrame, run_log: DataFrame, source: str, day_col: str, time_col: str, overlap_days: int = 1) -> DataFrame:
    """The rows of a table laid out by ``day_col`` from the newest successful run of ``source`` on, less an overlap.

    The watermark is a scalar subquery on the partition column: folders of earlier days
    are not listed into the scan. Without a successful run all rows are read.
    """
    since = incremental_since(run_log.where(F.col("source") == source), ["source"], overlap_days).agg(F.max("since").alias("since"))
    mark = F.coalesce(since.select(F.col("since").cast("date")).scalar(), F.to_date(F.lit("0001-01-01")))
    exact = F.coalesce(since.scalar(), F.to_timestamp(F.lit("0001-01-01 00:00:00")))
    return rows.where((F.col(day_col) >= mark) & (F.col(time_col) >= exact))


def split_rejects(rows: DataFrame, errors: Column, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(valid, rejected with their ``errors``, counts): one pass over ``rows``, written in two folders by the verdict.

    ``errors`` is an array of texts. The counts of rows and of each verdict are observed while writing.
    """
    spark, seen = rows.sparkSession, Observation()
    checked = rows.withColumn("errors", errors).withColumn("verdict", F.when(F.size("errors") == 0, "valid").otherwise("rejected"))
    watched = checked.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("verdict") == "valid").alias("valid"), F.count_if(F.col("verdict") == "rejected").alias("rejected"))
    watched.write.partitionBy("verdict").parquet(path)
    both = spark.read.schema(checked.schema).parquet(path)
    return both.where("verdict = 'valid'").drop("errors", "verdict"), both.where("verdict = 'rejected'").drop("verdict"), seen.get


def parse_json(raw: DataFrame, schema: str, col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(records, rejected): one row a text, and the texts that are no such record, nulls among them, as ``record``."""
    parsed = raw.select(F.col(col).alias("record"), F.from_json(col, f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    return parsed.where(~broken).select("r.*").drop("_broken"), parsed.where(broken).select("record")
