"""Generic keyed operators: top-k and latest per key, upserts, guards, splits, rule checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; only where that is unset and the master is local, under a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='landing-')}/landing-{uuid.uuid4().hex}"


def parts(rows: DataFrame, key: str, *of: str, size: int = 1000) -> DataFrame:
    """``rows`` with a ``part``: by a hash of ``of``, a key's rows fall into parts of about ``size`` each, one for a small key."""
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > size)  # few keys
    count = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1))
    return rows.join(many, key, "left").withColumn("part", F.pmod(F.xxhash64(*of), count).cast("int")).drop("_n")


def topk_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which should end in a unique column."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 1 within each key by ``order``, which should end in a unique column; no task has a whole key.

    Rows are dealt out by ranges of keys and order, numbered within a range, and moved on
    by the numbers of the key's earlier ranges. Null keys are a key; without ``keys`` all
    rows are numbered. The dealt rows are written to the shared folder, as both readers
    have to see the same ranges.
    """
    spark, path = rows.sparkSession, folder(rows.sparkSession)
    rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    own = spark.read.parquet(path).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = own.groupBy(*keys, "_part").agg(F.max("_rn").alias("_n")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_part") == F.col("_p"))
    return own.join(starts, same).withColumn(name, (F.col("_start") + F.col("_rn")).cast("int")).select(*rows.columns, name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk_per_key(df, keys, order, 1)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """``target`` and the source's first row of each key that it lacks."""
    return target.unionByName(latest_per_key(source, keys, arrival).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], newest: list[Column]) -> DataFrame:
    """Insert unseen keys; of known ones replace the columns ``update`` by the source's newest row."""
    s = latest_per_key(source, keys, newest).select(*(F.col(c).alias(f"_s_{c}") for c in target.columns), F.lit(True).alias("_s"))
    t = target.withColumn("_t", F.lit(True))
    joined = t.join(s, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys)), "full_outer")

    def value(c: str) -> Column:
        fresh = F.col("_s").isNotNull() if c in update else F.col("_t").isNull()
        return F.when(fresh, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*map(value, target.columns))


def only_new(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target lacks: ingested documents, missing dependents, orphans."""
    return source.join(target.select(*keys), keys, "left_anti")


def fk_guard(child: DataFrame, parent: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows of ``child``."""
    return child.join(parent.select(*keys), keys, "left_semi"), child.join(parent.select(*keys), keys, "left_anti")


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their ``errors``); ``errors`` is an array of texts."""
    checked = df.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def incremental_since(run_log: DataFrame, keys: list[str], overlap_days: int = 1) -> DataFrame:
    """(keys, since): the newest successful run with records, less an overlap; null for a full scan."""
    good = (F.col("status") == "success") & (F.col("records_count") > 0)
    return run_log.groupBy(*keys).agg((F.max(F.when(good, F.col("completed_at"))) - F.expr(f"INTERVAL {overlap_days} DAY")).alias("since"))


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and rule that does not hold; a null outcome holds, as in SQL checks."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def split_new_existing(source: DataFrame, target: DataFrame, keys: list[str], order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the target has, the first ``cap`` others in ``order``); the cap is the feature, the rest comes in a later run."""
    known = target.select(*keys)
    return source.join(known, keys, "left_semi"), source.join(known, keys, "left_anti").orderBy(*order).limit(cap)
