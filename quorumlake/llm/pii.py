"""Operator 9: personal data by bootstrapped contextual extraction, in built-in expressions only.

Base patterns find emails, IP addresses, card and phone numbers. Identifier-like slots
(tokens of five characters or more with a digit or @) stand in lexical patterns: the two words to their left, and
the word on either side. Slots that a base pattern covers are the seed instances of its
kind. Rounds follow on the graph of patterns and instances: a pattern is as good as the
share of its instances that are known to be of a kind, and confident if enough are; an
instance is as good as its confident patterns together. What is accepted in a round is
known in the next, where it supports patterns that no seed has, which in turn discover
further instances.

Java's regular expressions are written with possessive runs anchored at the start of
a run, which find the same leftmost matches as the plain forms, in linear time and
without recursion on long runs. Running sums and maxima over a text's matches go through
blocks of blocks, so that a text with very many matches costs about linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MUST = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An identifier-like slot: a token with a digit or @, and tokens of digits and their punctuation after it.
SLOT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[().0-9-]++(?!\S))*+"
LEAD, EDGES = r"^[(\[{<\"'=:]+", r"^[(\[{<\"'=:]+|[)\]}>\"',;:.!?]+$"
BLOCK, CHUNK = 64, 4096


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, combine) -> Column:
    """Inclusive running ``combine`` (of sum or maximum) over an array of longs of 0 or more, by blocks and blocks of blocks."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), combine)
    part = lambda of, at, n: F.slice(of, (at + 1).cast("int"), n.cast("int"))

    def blocks(of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / BLOCK).cast("int")), lambda b: total(part(of, b * BLOCK, F.lit(BLOCK))))

    def each(one: Column, two: Column, three: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            low, high = F.floor(i / BLOCK), F.floor(i / (BLOCK * BLOCK))
            return combine(combine(total(part(three, F.lit(0), high)), total(part(two, high * BLOCK, low - high * BLOCK))), total(part(one, low * BLOCK, i - low * BLOCK + 1)))

        return F.transform(one, at)

    short = lambda one: F.transform(one, lambda x, i: total(part(one, F.lit(0), i + 1)))
    long = lambda one: _let(blocks(one), lambda two: _let(blocks(two), lambda three: each(one, two, three)))
    return _let(numbers, lambda one: F.when(F.size(one) <= BLOCK, short(one)).otherwise(long(one)))


def _placed(gaps: Column, matches: Column) -> Column:
    """array<struct<s, e, m>>: the matches with code-point positions, from the pieces between them (one more than matches)."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    place = lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return F.when(F.size(matches) == 0, empty).otherwise(F.zip_with(matches, _running(steps, lambda a, x: a + x), place))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _matches(text: Column, pattern: str, must: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if must is None else F.when(F.contains(text, F.lit(must)), found).otherwise(F.array().cast("array<string>"))


def _contexts(gaps: Column, slots: Column) -> Column:
    """For every slot its patterns, lower-cased and with digits as 0: ``a b _`` and ``b _ c``; those that reach over the text's ends are left out."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")

    def of(m: Column, i: Column) -> Column:
        before = F.concat_ws("", F.get(slots, i - 2), F.get(gaps, i - 1), F.get(slots, i - 1), F.get(gaps, i))  # two tokens, if the text has so many
        two = F.regexp_extract(before, r"(?:^|\s)(\S++\s++\S++)\s*+$", 1)
        one = F.regexp_extract(before, r"(?:^|\s)(\S++)\s*+$", 1)
        after = F.regexp_extract(F.concat_ws("", F.get(gaps, i + 1), F.get(slots, i + 1)), r"^\s*+(\S++)", 1)
        left = F.when(two != "", F.concat(plain(F.regexp_replace(two, r"\s+", " ")), F.lit(" _")))
        around = F.when((one != "") & (after != ""), F.concat(plain(one), F.lit(" _ "), plain(after)))
        return F.array_compact(F.array(left, around))

    return F.transform(slots, of)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, base, slots, seeds): per row the base spans (s, k, kind, e, m), ordered, the uncovered slots (s, e, m, patterns) and the base spans as seeds (kind, m, patterns).

    ``h`` is a hash of the text. Positions are code points from 0, ends exclusive.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("*", *(_matches(F.col("text"), PATTERNS[k], MUST[k]).alias(f"m_{k}") for k in KINDS), F.regexp_extract_all("text", F.lit(SLOT), F.lit(0)).alias("m_slot"))
    none = F.array().cast("array<string>")
    pieces = lambda kind, pattern: F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none)

    def kept(k: int, kind: str) -> Column:
        good = F.filter(_placed(pieces(kind, PATTERNS[kind]), F.col(f"m_{kind}")), lambda x: _valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))

    def placed_slots(gaps: Column) -> Column:
        def slot(x: Column, patterns: Column) -> Column:
            core = F.regexp_replace(x["m"], EDGES, "")
            lead = F.length(F.regexp_extract(x["m"], LEAD, 0))
            return F.struct(x["s"].alias("raw"), (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), F.lower(core).alias("m"), patterns.alias("patterns"))

        return F.zip_with(_placed(gaps, F.col("m_slot")), _contexts(gaps, F.col("m_slot")), slot)

    based = found.select("doc_id", F.xxhash64("text").alias("h"), F.array_sort(F.concat(*(kept(k, kind) for k, kind in enumerate(KINDS)))).alias("base"), _let(pieces("slot", SLOT), placed_slots).alias("all"))

    # base spans and slots in one line by start, a slot before the base spans that begin with it
    own = F.transform("all", lambda x, i: F.struct(x["raw"].alias("s"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("end"), (i + 1).cast("long").alias("slot"), F.lit(0).alias("at")))
    others = F.transform("base", lambda b, i: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("end"), F.lit(0).cast("long").alias("slot"), (i + 1).alias("at")))
    line = based.select("*", F.when((F.size("base") > 0) & (F.size("all") > 0), F.array_sort(F.concat(own, others))).otherwise(own).alias("line"))
    most = lambda a, x: F.greatest(a, x)
    run = lambda field: F.when(F.size("base") > 0, _running(F.transform("line", lambda x: x[field]), most))
    line = line.select("*", run("end").alias("reach"), run("slot").alias("last"))
    slot_at = lambda number: F.get("all", (number - 1).cast("int"))

    def free(x: Column, i: Column) -> Column:
        y, after = slot_at(x["slot"]), F.get("line", i + 1)
        covered = (F.get("reach", i) > y["s"]) | ((after["at"] > 0) & (after["s"] < y["e"]))
        return (x["slot"] > 0) & (F.length(y["m"]) >= 5) & ~F.coalesce(covered, F.lit(False))

    def uncovered(x: Column) -> Column:
        y = slot_at(x["slot"])
        return F.struct(y["s"].alias("s"), y["e"].alias("e"), y["m"].alias("m"), y["patterns"].alias("patterns"))

    seeds = F.filter(F.transform("line", lambda x, i: F.when((x["at"] > 0) & (F.get("last", i) > 0), F.struct(F.get("base", x["at"] - 1)["kind"].alias("kind"), F.lower(F.get("base", x["at"] - 1)["m"]).alias("m"), slot_at(F.get("last", i))["patterns"].alias("patterns")))), lambda x: x.isNotNull())
    return line.select("doc_id", "h", "base", F.transform(F.filter("line", free), uncovered).alias("slots"), seeds.alias("seeds"))


def edges(found: DataFrame) -> DataFrame:
    """(pattern, m, kind): which instances stand in which patterns; ``kind`` is that of seeds, else null."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.m", "x.kind", F.explode("x.patterns").alias("pattern"))
    other = found.select(F.explode("slots").alias("x")).select("x.m", F.lit(None).cast("string").alias("kind"), F.explode("x.patterns").alias("pattern"))
    return seeds.unionByName(other).groupBy("pattern", "m").agg(F.min("kind").alias("kind"))


def bootstrap(graph: DataFrame, rounds: int = 4, support: int = 3, confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(instances (m, kind, score), patterns (pattern, kind, score)) that ``rounds`` rounds on ``edges`` accept.

    A round scores every pattern by the summed scores of its known instances of a kind
    over the number of its instances; it is confident with a score of ``confidence`` or
    more and ``support`` known instances. An unknown instance scores 1 - prod(1 - p) over
    its confident patterns of a kind and is accepted from ``confidence`` on, for its best
    kind, ties by the order of ``KINDS``; it is known, with its score, in the next round.
    Seeds keep the score 1. Rounds end early when one gives the same instances and scores
    as the one before. An empty graph gives no rows.
    """
    rank = reduce(lambda a, b: a.when(F.col("kind") == b[1], b[0]), enumerate(KINDS[1:], 1), F.when(F.col("kind") == KINDS[0], 0))
    seeds = graph.where("kind IS NOT NULL").groupBy("m").agg(F.min(F.struct(rank.alias("k"), "kind"))["kind"].alias("kind"))
    seeds = cut(seeds.withColumn("score", F.lit(1.0)))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    accepted, before = seeds.limit(0), None
    for _ in range(rounds):
        known = seeds.unionByName(accepted)
        hits = graph.select("pattern", "m").join(known, "m").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("known")).where(F.col("known") >= support)
        patterns = cut(hits.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score")).where(F.col("score") >= confidence))
        reached = graph.select("pattern", "m").join(patterns, "pattern").join(seeds.select("m"), "m", "left_anti")
        rated = reached.groupBy("m", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.99)))))).alias("score"))
        best = rated.groupBy("m").agg(F.min(F.struct((-F.col("score")).alias("less"), rank.alias("k"), "kind")).alias("best"))
        accepted = cut(best.select("m", "best.kind", (-F.col("best.less")).alias("score")).where(F.col("score") >= confidence))
        mark = tuple(accepted.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("m", "kind", F.round("score", 6))), F.lit(0))).first())
        if mark == before or not mark[0]:
            break
        before = mark
    return accepted, patterns


def _text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def extract(docs: DataFrame, rounds: int = 4, support: int = 3, confidence: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, base, all): every row's base spans, and all spans with those discovered.

    ``h`` is xxhash64 of the text (null: of the empty one). Spans are structs (s, k,
    kind, e), ordered by start and then kind. A slot is a discovered span where its
    instance is accepted and a confident pattern of the same kind introduces it; such
    spans never overlap base ones. A text's time grows with its length and its matches.
    Rows without a find have empty arrays; repeated rows give repeated results; an empty
    table gives no rows.
    """
    found = cut(spans(docs, id_col, text_col))
    accepted, patterns = bootstrap(cut(edges(found)), rounds, support, confidence)
    uses = found.select("doc_id", "h", F.explode("slots").alias("x")).select("doc_id", "h", "x.s", "x.e", "x.m", F.explode("x.patterns").alias("pattern"))
    uses = uses.join(accepted.select("m", "kind"), "m").join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    number = reduce(lambda a, b: a.when(F.col("kind") == b[1], b[0]), enumerate(KINDS[1:], 1), F.when(F.col("kind") == KINDS[0], 0))
    more = uses.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("s", number.alias("k"), "kind", "e")).alias("_more"))
    slim = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["kind"].alias("kind"), b["e"].alias("e")))
    none = F.array().cast("array<struct<s:bigint,k:int,kind:string,e:bigint>>")
    joined = found.select("doc_id", "h", slim.alias("base")).join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("_more", none))).alias("all"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest and the text of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"))


def _masked(text: Column, found: Column) -> Column:
    """``text`` with every stretch of overlapping spans of ``found`` as the ``[KIND]`` of its first."""

    def done(chunks: Column, x: Column, run: Column) -> Column:
        end = lambda i: F.coalesce(F.get(run, (i - 1).cast("int")), F.lit(0).cast("long"))  # noqa: E731  where what stands before span i ends

        def piece(a: Column, z: Column) -> Column:
            i, j = F.floor(a / CHUNK).cast("int"), F.floor(z / CHUNK).cast("int")
            chunk = lambda at: F.coalesce(F.get(chunks, at), F.lit(""))
            wide = F.concat(F.substring(chunk(i), (a % CHUNK + 1).cast("int"), F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(chunk(j), F.lit(1), (z % CHUNK).cast("int")))
            return F.when(i == j, F.substring(chunk(i), (a % CHUNK + 1).cast("int"), (z - a).cast("int"))).otherwise(wide)

        heads = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["s"] >= end(i))
        parts = F.transform(heads, lambda i: F.concat(piece(end(i), F.get(x, i)["s"]), F.lit("["), F.upper(F.get(x, i)["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), piece(end(F.size(x)), F.length(text).cast("long")))

    run = lambda x: _running(F.transform(x, lambda y: y["e"]), lambda a, y: F.greatest(a, y))
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0)), lambda chunks: _let(found, lambda x: _let(run(x), lambda r: done(chunks, x, r))))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every span of ``extract`` in the text replaced by ``[KIND]``.

    Spans that overlap are replaced together, by the kind of the first. Null texts stay
    null; repeated rows stay repeated; an empty table gives no rows. A column
    ``n_chars``, if there is one, is set to the new length.
    """
    found = extract(docs, id_col=id_col, text_col=text_col).where(F.size("all") > 0)
    one = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.first("all").alias("_all"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    joined = rows.join(one, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("_text", F.lit(""))) == F.col("_h")), "left")
    new = joined.select("_row", F.when(F.col("_all").isNotNull(), _masked(F.col("_text"), F.col("_all"))).otherwise(F.col("_text")).alias("_new"))
    fields = []
    for f in docs.schema.fields:
        value = F.col("_row").getField(f.name)
        if f.name == text_col:
            value = F.col("_new").cast(f.dataType)
        elif f.name == "n_chars" and text_col == "text":
            value = F.coalesce(F.length("_new").cast(f.dataType), value)
        fields.append(value.alias(f.name))
    return new.select(*fields)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(extract(table(spark, sf_dir, "documents")))
