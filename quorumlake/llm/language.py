"""Operator 7: language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample
of its texts. A text is compressed with every dictionary, and the language whose
dictionary gives the smallest size wins; a narrow margin to the runner-up marks
the answer as rejected. A text is compressed in blocks of its own, so that a
dictionary helps all along it and the margin is the same share at any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import residue, resident, sliced

BLOCK = 16_384  # bytes

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 256, sample_chars: int = 8192, dict_bytes: int = 112_640) -> dict[str, bytes]:
    """{language: dictionary content} from rows with a language and a text.

    The sample is bounded by its parameters: per language ``sample_docs`` different
    texts (those of the least hash), of each ``sample_chars`` characters at most, from a
    place that the hash chooses in the whole text, together at most ``dict_bytes`` bytes.
    Before texts are ranked, each task drops those whose hash is above a threshold that
    leaves about four times as many of a language, so that no language is gathered whole.
    No such rows: no languages.
    """
    h = F.xxhash64("text", F.lit("sample"))
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null and text <> ''").withColumn("h", h)
    limits = {r.lang: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * sample_docs // max(1, r.n)) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # one row a language
    if not limits:
        return {}
    low = F.create_map(*(F.lit(x) for lang, limit in limits.items() for x in (lang, limit)))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    some = rows.where(F.col("h") <= F.element_at(low, F.col("lang"))).groupBy("lang", "h").agg(F.min(F.substring("text", place, F.lit(sample_chars))).alias("text"))
    picked = some.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= sample_docs)
    parts: dict[str, list[str]] = {}
    for r in picked.select("lang", "rn", "text").collect():  # bounded: sample_docs * sample_chars a language
        parts.setdefault(r.lang, []).append((r.rn, r.text))
    share = lambda texts: max(64, dict_bytes // len(texts))

    def content(texts: list[tuple[int, str]]) -> bytes:
        pieces = [t.encode() for _, t in sorted(texts)]
        even = [p[: share(pieces)] for p in pieces]
        more = [p[share(pieces) :] for p in pieces]  # filled up from what the even shares leave
        return b"\n".join([*more, *even])[-dict_bytes:]

    return {lang: content(texts) for lang, texts in parts.items()}


def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    import zstandard as z

    out = []
    for lang, content in model:
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def decide(text: str | None, compressors, margin: float, sharpness: float = 0.15) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text."""
    if not compressors or not text or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    raw = text.encode()
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    best = sizes[0][0]
    score = 1 / sum(math.exp(max(-700.0, sharpness * (best - n))) for n, _ in sizes)
    gap = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    return sizes[0][1], score, gap, gap < margin


def _run(model: dict[str, bytes], level: int):
    return tuple(sorted(model.items())), level


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = 0.002, level: int = 9, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) for every row.

    ``lang_pred`` is a language of ``model``, or ``und`` (score 0, rejected) if the
    text is null or has no letter; equal sizes go to the first language by name.
    ``margin`` is the least lead over the runner-up, as a share of the best size,
    below which a row counts as rejected; the prediction stays. Repeated rows give
    repeated results; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_run(model, level))  # languages * dict_bytes

    def task(batches):
        import pyarrow as pa

        compressors = resident(("language", shared.value), lambda: _compressors(*shared.value))
        for batch in sliced(batches):
            got = [decide(t, compressors, margin) for t in batch.column(2).to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, RESULT)


def keep(docs: DataFrame, model: dict[str, bytes], margin: float = 0.002, level: int = 9, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found by at least ``margin``.

    Null and letterless texts and ties between languages go; repeated rows fare alike; an
    empty table gives no rows. Time grows with a text's length and the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_run(model, level))
    at = docs.columns.index(text_col)

    def task(batches):
        import pyarrow as pa

        compressors = resident(("language", shared.value), lambda: _compressors(*shared.value))
        for batch in sliced(batches):
            yield batch.filter(pa.array([not decide(t, compressors, margin)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(residue("doc_id", 3) != 1)), held_out=residue("doc_id", 3) == 1)
