"""Small helpers that the corpus operators share.

Conventions of this subpackage: operators take DataFrames and the names of the
columns they read, select those columns at once (so extra columns, whatever
their names, cannot clash), and return a narrow DataFrame. A null text counts as
an empty one unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_held: dict = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, held by a Python worker for its next tasks until one asks for another key.

    Workers outlive stages; so an operator's model does not stay when the next operator runs.
    """
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Let a worker go of what ``resident`` holds for another operator, and give freed memory back to the machine."""
    if _held:
        _held.clear()
        gc.collect()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
        trim(0)


def sliced(batches: Iterable, rows: int = 512):
    """Arrow batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slim(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session hands at most ``rows`` rows at once to Python workers.

    Spark's 10,000 texts a batch are held several times, by the executor's writer and by the worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tidy(spark: SparkSession) -> None:
    """From now on the session removes the shuffle files of a query when it has ended.

    Else they stay until the driver happens to collect its garbage, and an operator that
    runs many short queries holds the files of all of them. A later reader of such files
    lets Spark run their stage again; so ``toLocalIterator``, which reads when its query
    has ended, is for results of ``cut`` and ``stored`` only.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests on one machine) a temporary folder is used.
    Spark removes the files of results that are no longer referred to if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared checkpoint folder and read again: as ``cut``, for large results.

    Results are read from these tables, so they stay until ``clear`` is called.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table of a result of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.search(r"/stored-[0-9a-f]{32}$", folder):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables of ``stored``; call it when the session's results have been written."""
    if spark.sparkContext.getCheckpointDir():
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "stored-*")) or []:
            fs.delete(status.getPath(), True)


def dense(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """Narrow ``df`` of at most about ``rows`` rows in as many tasks as these fill, two at least, and not one for each partition of its shuffle."""
    return df.coalesce(max(2, -(-rows // per_task)))


def gapless(df: DataFrame, key: str, order: list[str], out: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps, whatever the size of a key.

    ``rows`` is the row count of ``df``, which should be materialised (it is read
    twice). Rows are dealt to buckets by a hash of ``order``; a bucket's first
    number is the count of the key's earlier buckets, so that no task sorts a
    whole key. Rows equal in all of ``order`` are numbered arbitrarily.
    """
    buckets = max(1, -(-rows // per_bucket))
    held = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("gapless")), F.lit(buckets)).cast("int"))
    sizes = held.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = held.withColumn("_rn", F.row_number().over(within))
    return numbered.join(starts, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_bucket") == F.col("_b"))).withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_bucket", "_rn", "_key", "_b", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected long ``edges`` (a, b); root is the component's least node.

    Alternating large-star and small-star steps: each step is an aggregation to
    the least neighbour and a join on the node, so that no neighbour list is ever
    collected. A step has tasks by the number of edges. The number of rounds grows with
    the logarithm of the input. Self loops and repeated edges are allowed; no edges give no rows.
    """
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut(rows), None
    n = now.count()  # no step has more edges
    while True:
        now = dense(now, n)
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = dense(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"), n)
        large = dense(large.distinct(), n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(dense(dense(small, n).union(dense(low.select("a", F.col("m").alias("b")), n)).distinct(), n))
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
