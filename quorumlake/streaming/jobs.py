"""Structured Streaming forms of the keyed upsert and the monthly counts.

A table that streams merge into is a folder of batches, ``_batch=<id>/_bucket=<n>``.
A batch holds the whole new content of the buckets it touched, and counts once Spark has
written its success marker. Readers take of every bucket the greatest finished batch. So
nothing is replaced in place: a batch that fails on its way leaves the table as it was,
and one that is run again writes its own folder again, from the batches before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import insert_ignore, upsert

BUCKET, BATCH, LAYOUT = "_bucket", "_batch", "layout"
ROWS = 1_000_000  # of a bucket


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, its Path class)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _batches(spark: SparkSession, path: str, before: int | None = None) -> Iterator[tuple[int, str]]:
    """(id, folder) of the finished batches, the newest first; only those before ``before``, if it is given."""
    fs, place = _files(spark, path)
    found = [(int(name.partition("=")[2]), str(s.getPath())) for s in fs.listStatus(place(path)) if (name := s.getPath().getName()).startswith(f"{BATCH}=")]
    for number, folder in sorted(found, reverse=True):
        if (before is None or number < before) and fs.exists(place(folder, "_SUCCESS")):
            yield number, folder


def _current(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of every bucket that has rows: at most one for each bucket."""
    fs, place = _files(spark, path)
    out: dict[int, str] = {}
    for _, folder in _batches(spark, path, before):
        for s in fs.listStatus(place(folder)):
            name = s.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                out.setdefault(int(name.partition("=")[2]), str(s.getPath()))
    return out


def _layout(spark: SparkSession, path: str) -> tuple[int, str]:
    """(number of buckets, schema of the rows as DDL)."""
    row = spark.read.schema("buckets int, ddl string").json(f"{path}/{LAYOUT}").first()
    return row.buckets, row.ddl


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> None:
    """Write ``rows`` as a table for ``stream_upsert``; by default in buckets of about ``ROWS`` rows by a hash of the keys."""
    buckets = buckets or max(1, -(-rows.count() // ROWS))
    rows.sparkSession.createDataFrame([(buckets, rows._jdf.schema().toDDL())], "buckets int, ddl string").coalesce(1).write.json(f"{path}/{LAYOUT}")
    _write(rows, path, keys, buckets, 0)


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int, number: int) -> None:
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(f"{path}/{BATCH}={number}")


def read_table(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, as of before the batch ``before``, and of some ``buckets`` only, if these are given."""
    _, ddl = _layout(spark, path)
    now = _current(spark, path, before)
    folders = [f for b, f in now.items() if buckets is None or b in buckets]
    return spark.read.schema(ddl).parquet(*folders) if folders else spark.createDataFrame([], ddl)


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], update: list[str] | None, newest: list) -> None:
    """Merge one batch of the given number (from 1 on) into the table at ``path``.

    Known keys get the columns ``update`` of the batch's newest row; with ``update``
    None they stay as they are (insert-ignore). Only buckets that hold keys of the batch
    are read and written again. A batch that has been finished changes nothing when it
    is run again; an empty one never does. Batches of one table must not run side by side.
    """
    spark = batch.sparkSession
    fs, place = _files(spark, path)
    if fs.exists(place(f"{path}/{BATCH}={number}", "_SUCCESS")):
        return
    buckets, ddl = _layout(spark, path)
    touched = [r[0] for r in batch.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).distinct().collect()]  # at most `buckets`
    if touched:
        table = read_table(spark, path, number, touched)
        source = batch.select(*table.columns)
        merged = insert_ignore(table, source, keys, newest) if update is None else upsert(table, source, keys, update, newest)
        _write(merged, path, keys, buckets, number)


def stream_upsert(stream: DataFrame, path: str, keys: list[str], update: list[str] | None, newest: list, checkpoint: str, buckets: int = 64):
    """Start a query that merges every micro-batch into the table at ``path``, as ``merge_batch``.

    If there is no table, an empty one of ``buckets`` is created. A query with a new ``checkpoint`` numbers its batches after those of the table; they
    are told apart by what the table held when the checkpoint was first used.
    """
    spark = stream.sparkSession
    fs, place = _files(spark, path)
    if not fs.exists(place(f"{path}/{LAYOUT}", "_SUCCESS")):
        create_table(spark.createDataFrame([], stream.schema), path, keys, buckets)
    fs, place = _files(spark, checkpoint)
    mark = f"{checkpoint}/first-batch"
    if not fs.exists(place(mark, "_SUCCESS")):
        first = max((n for n, _ in _batches(spark, path)), default=0) + 1
        spark.createDataFrame([(first,)], "first long").coalesce(1).write.mode("overwrite").json(mark)
    first = spark.read.schema("first long").json(mark).first().first
    merge = lambda batch, number: merge_batch(batch, first + number, path, keys, update, newest)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the folders of buckets that readers no longer take, but for the newest ``keep`` batches; how many went."""
    fs, place = _files(spark, path)
    now, gone = set(_current(spark, path).values()), 0
    for number, folder in list(_batches(spark, path))[keep:]:
        for s in fs.listStatus(place(folder)):
            if s.getPath().getName().startswith(f"{BUCKET}=") and str(s.getPath()) not in now:
                gone += bool(fs.delete(s.getPath(), True))
    return gone


def daily_counts(stream: DataFrame, time_col: str = "ts", kind_col: str = "event_type", late: str = "2 days") -> DataFrame:
    """Counts a day and kind with bounded lateness; months are rolled up from days in batch.

    In append mode a day comes out once, when the watermark has passed its end; rows of
    days that have come out are dropped.
    """
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day"), F.col(kind_col).alias("kind")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), "kind", "n")


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "kind").agg(F.sum("n").alias("n"))
