"""Names to entities: cascades of exact, folded, token, district and first-name rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_name, strip_suffix


def _unique(hits: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the entity of keys with exactly one candidate."""
    return hits.groupBy(key).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias(name)).where("n = 1").drop("n")


def resolve_lower(source: DataFrame, entity: DataFrame, key: str = "src_id", small: int = 200_000) -> DataFrame:
    """(key, entity_id): source rows (key, state, last, district) resolved within their state.

    Exact folded last name; where no name matches, a token of a compound name; of several
    the one of the district; a source without a district takes the only senator. Rows that
    stay ambiguous have a null entity; rows of one key share their candidates. A pick has a
    single candidate if its least is its greatest, so entities are first summed up by name
    and by name and district, and a source row meets one row of either, however many
    entities have its name. Up to ``small`` such rows are sent to every task.
    """
    last = fold_name(F.col("last_name"))
    forms = F.concat(F.array(F.struct(F.lit(True).alias("exact"), last.alias("form"))), F.transform(F.split(last, r"[\s-]+"), lambda t: F.struct(F.lit(False).alias("exact"), t.alias("form"))))
    e = entity.select("entity_id", F.col("state").alias("_state"), F.col("district").alias("_district"), "chamber", F.inline(forms)).where("_state IS NOT NULL AND form IS NOT NULL")
    bounds = {(n, exact): (f"_{n}{int(exact)}_lo", f"_{n}{int(exact)}_hi") for exact in (True, False) for n in "abc"}  # all, of the district, senators
    pick = lambda n, one: [f(F.when(F.col("exact") == exact, F.when(one, F.col("entity_id")))).alias(name) for exact in (True, False) for f, name in zip((F.min, F.max), bounds[n, exact])]
    names = e.groupBy("_state", "form").agg(*pick("a", F.lit(True)), *pick("c", F.col("chamber") == "senate"))
    seats = e.where("_district IS NOT NULL").groupBy("_state", "form", "_district").agg(*pick("b", F.lit(True)))
    size = names.agg(F.count("*").alias("n")).unionAll(seats.agg(F.count("*"))).agg(F.max("n")).first()[0]

    # rows without a key are alone
    s = source.select(key, "state", "district", fold_name(strip_suffix(F.col("last"))).alias("_name")).withColumn("_lone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    dealt = lambda df: df.repartition(key, "_lone")
    if size <= small:
        s, names, seats = dealt(s), F.broadcast(names), F.broadcast(seats)
    names, seats = names.withColumnsRenamed({"_state": "_state_a", "form": "_form_a"}), seats.withColumnsRenamed({"_state": "_state_b", "form": "_form_b"})
    met = s.join(names, (F.col("state") == F.col("_state_a")) & (F.col("_name") == F.col("_form_a")), "left").join(seats, (F.col("state") == F.col("_state_b")) & (F.col("_name") == F.col("_form_b")) & (F.col("district") == F.col("_district")), "left")
    met = met.select(key, "_lone", *(F.when(F.col("district").isNull(), F.col(c)).alias(c) if n == "c" else F.col(c) for (n, _), both in bounds.items() for c in both))
    met = met if size <= small else dealt(met)
    found = met.groupBy(key, "_lone").agg(F.count("*").alias("_n"), *(f(name).alias(name) for both in bounds.values() for f, name in zip((F.min, F.max), both)))
    single = lambda lo, hi: F.when(F.col(lo) == F.col(hi), F.col(lo))
    by = lambda exact: F.coalesce(*(single(*bounds[n, exact]) for n in "abc"))
    one = F.when(F.col(key).isNotNull(), F.when(F.col(bounds["a", True][0]).isNotNull(), by(True)).otherwise(by(False)))
    return found.select(key, one.alias("entity_id"), F.explode(F.array_repeat(F.lit(True), F.col("_n").cast("int")))).drop("col")


def resolve_upper(source: DataFrame, entity: DataFrame, key: str = "src_id") -> DataFrame:
    """(key, entity_id): source rows (key, first, last) among senators; several are told apart by the first name's three letters."""
    e = entity.where("chamber = 'senate'").select("entity_id", fold_name(F.col("last_name")).alias("_last"), fold_name(F.col("first_name")).alias("_first"))
    s = source.withColumn("_name", fold_name(strip_suffix(F.col("last")))).withColumn("_given", F.substring(fold_name(F.col("first")), 1, 3))
    hits = s.join(e, F.col("_name") == F.col("_last"))
    first = hits.where(F.col("_first").startswith(F.col("_given"))).groupBy(key).agg(F.min("entity_id").alias("_b"))
    return s.select(key).join(_unique(hits, key, "_a"), key, "left").join(first, key, "left").select(key, F.coalesce("_a", "_b").alias("entity_id"))
