"""Releases: keywords, timelines, briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import topk_per_key

# Words that are no keywords.
STOP_WORDS = ["a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "that", "this", "was", "are", "be", "has", "had", "have", "will", "would", "could", "should", "may", "can", "do", "does", "did", "been", "being", "its", "his", "her", "he", "she", "they", "them", "their", "our", "we", "us", "you", "your", "my", "as", "if", "not", "no", "so", "up", "out", "about", "into", "over", "after", "before", "between", "through", "during", "under", "above", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "than", "too", "very", "just", "also", "now", "new", "one", "two", "first", "who", "which", "what", "when", "where", "how", "why", "rep", "sen", "senator", "representative", "congressman", "congresswoman", "statement", "announces", "announced", "press", "release", "says", "said", "joins", "introduces", "introduced", "supports", "support", "votes", "vote", "bill", "act", "legislation", "office", "today", "bipartisan", "calls", "urges", "applauds", "response"]
# Phrases that count as one keyword.
PHRASES = ["border security", "national security", "climate change", "gun violence", "health care", "healthcare", "mental health", "small business", "law enforcement", "public safety", "social security", "student loan", "tax cut", "tax relief", "minimum wage", "drug prices", "prescription drug", "child care", "childcare", "foreign aid", "national defense", "veterans affairs", "infrastructure bill", "supreme court", "federal funding", "government shutdown", "debt ceiling", "immigration reform", "election integrity", "voting rights", "civil rights", "human rights", "clean energy", "renewable energy", "fossil fuel", "water resources", "affordable housing", "food safety", "fentanyl", "opioid"]


def keywords(titles: DataFrame, key: str, title: str = "title", k: int = 12, phrases: list[str] = PHRASES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, term, n, is_phrase, rank): the commonest phrases and words of each key's titles.

    A phrase counts once a title, a word as often as it occurs, from 2 on; words
    within a counted phrase are left out. Ties: phrases first, then by term.
    """
    low = titles.select(F.col(key), F.lower(F.col(title)).alias("t")).where("t IS NOT NULL")
    hit = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(p)), F.lit(p)) for p in phrases)))
    found = low.select(key, F.explode(hit).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n")).withColumn("is_phrase", F.lit(True))
    words = low.select(key, F.explode(F.split(F.regexp_replace("t", r"[^a-z\s'-]", ""), r"\s+")).alias("term")).where((F.length("term") > 3) & ~F.col("term").isin(stop_words))
    counted = words.groupBy(key, "term").agg(F.count("*").alias("n")).where("n >= 2")
    inside = found.groupBy(key).agg(F.collect_set("term").alias("_p"))  # at most the phrase list
    free = counted.join(inside, key, "left").where(~F.coalesce(F.exists("_p", lambda p: F.contains(p, F.col("term"))), F.lit(False))).select(key, "term", "n", F.lit(False).alias("is_phrase"))
    return topk_per_key(found.unionByName(free), [key], [F.desc("n"), F.desc("is_phrase"), F.asc("term")], k, "rank")


def activity_timeline(releases: DataFrame, items: DataFrame, ballots: DataFrame, k: int = 30) -> DataFrame:
    """Per entity the newest of releases (50), items (30) and ballots (30): date, kind, title, rank.

    Inputs: (entity_id, date, id, title). Undated rows are left out; at equal dates
    releases come first, then items, then ballots, each by its own order.
    """
    parts = []
    for n, (kind, df, top) in enumerate((("press", releases, 50), ("bill", items, 30), ("vote", ballots, 30))):
        rows = df.where("date IS NOT NULL").select("entity_id", "date", F.col("id").cast("string").alias("id"), "title")
        parts.append(topk_per_key(rows, ["entity_id"], [F.desc("date"), F.asc("id")], top, "_r").select("entity_id", "date", F.lit(n).alias("_k"), F.lit(kind).alias("kind"), "id", "title", "_r"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return topk_per_key(every, ["entity_id"], [F.desc("date"), F.asc("_k"), F.asc("_r")], k, "rank").drop("_k", "_r")
