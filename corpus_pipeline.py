"""A training-corpus pipeline: documents in, packed sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last keep the columns of ``documents``, and extra ones, whatever their names. An
empty table of documents passes through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import language, near, packing, pii, toxicity
from quorumlake.llm.common import discard, residue, slim, stored, table, tidy


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells, learned from ``docs`` by ``lang``.

    Null and letterless texts, ties and narrow margins go; without a row that has a
    language all go. Repeated rows fare alike.
    """
    slim(spark)
    return language.keep(docs, language.fit(docs.where(residue("doc_id", 3) != 1)))


def low_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.7, learned from the table ``labels``.

    Null and empty texts stay unless nearly all labels are toxic. Repeated rows fare alike.
    """
    slim(spark)
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), residue("id", 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more), that with the least id.

    SimHash finds near copies first, an exact join those at which it fails.
    Texts without a word, null ones among them, are one group. A null id is least only in
    a group without others; of rows alike in id and text one stays.
    """
    slim(spark)
    tidy(spark)
    return near.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts and repeated rows stay as they are."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens; a null text is an empty document, one token long."""
    import public_tokenizers as tokenizers

    slim(spark)
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", low_toxicity),
    ("simhash_near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: SQL can express none of the stages; tests hold the chain against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(last)  # leaves the input alone: only tables of `stored` go
    return STAGES[-1][1](spark, docs, sf_dir)
