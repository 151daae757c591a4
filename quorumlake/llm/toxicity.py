"""Operator 1: toxicity by noisy-channel deobfuscation.

A written token is taken as a noisy copy of clean words: letters may stand as digits
or signs, be spread by spaces or punctuation, or be repeated. Its readings form a
lattice of characters, and a Viterbi search finds the reading that a character
trigram model and the channel's costs make likeliest. The trigram counts are gathered
from the texts of all documents. Restored words are then scored by word and word-start
features whose log odds are learned from labelled rows, and a logistic curve over a
document's evidence gives the score.

Tokens are decoded that hold signs, a letter twice running, or three or more signs and
no letter; so are runs of short tokens of which one, by the character model, is unlikely
to end where it does. Time grows with a text's length and its different tokens.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, residue, resident, sliced

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i", "£": "l", "µ": "u",
    "*": "aeiou", "#": "aeiou",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIGN_COST, DROP_COST, GAP_COST, REPEAT_COST = 1.0, 2.5, 0.7, 0.4
PREFIXES = (4, 5, 6, 7)
EDGE = ".,;:?\"'()[]{}<>…«»“”‘’`~^=\\/"
SIZE = len(LETTERS) + 1  # 0 is the word boundary
SHORT, ODD = 3, math.log(0.05)
SPAN = 1 << 18  # characters counted at once
TWICE = re.compile(r"(.)\1")


class Model(NamedTuple):
    trigram: np.ndarray  # log probability of [before, last, next]
    weights: dict[str, float]
    curve: tuple[float, float, float]  # intercept, evidence, density


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts [before, last, next] over LETTERS and the boundary, from the texts of all rows."""

    def task(batches):
        import pyarrow as pa

        release()
        lut = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(LETTERS):
            lut[ord(c)] = i + 1
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in sliced(batches):
            text = "  " + "  ".join(t for t in batch.column(0).to_pylist() if t).lower() + "  "
            for at in range(0, len(text) - 2, SPAN):  # two characters more, so that no trigram is lost
                s = lut[np.frombuffer(text[at : at + SPAN + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
                total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    out = np.zeros(SIZE**3)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(task, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most SIZE ** 3 rows
        out[r.code] = r.n
    return out.reshape(SIZE, SIZE, SIZE)


def trigram(counts: np.ndarray) -> np.ndarray:
    """Log probabilities with the bigram's as backing."""
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5))


class Decoder:
    def __init__(self, model: np.ndarray):
        self.logp = model.tolist()
        self.code = {c: i + 1 for i, c in enumerate(LETTERS)}

    def lattice(self, token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each written character its readings (text, cost): a letter, nothing, or a space."""
        out: list[list[tuple[str, float]]] = []
        for i, c in enumerate(token):
            if c in self.code:
                readings = [(c, 0.0)]
                if i > 1 and token[i - 1] == c == token[i - 2]:
                    readings = [("", REPEAT_COST), (c, REPEAT_COST)]
                elif i and token[i - 1] == c and i + 1 < len(token) and token[i + 1] == c:
                    readings = [("", REPEAT_COST), (c, REPEAT_COST)]
                elif i and token[i - 1] == c:
                    readings = [(c, 0.0), ("", REPEAT_COST)]
            elif c in LEET:
                readings = [(x, SIGN_COST) for x in LEET[c]] + [("", DROP_COST), (" ", DROP_COST)]
            elif c.isalpha():
                readings = [(c, 0.0)]
            else:
                readings = [("", GAP_COST), (" ", 0.0 if spaced else GAP_COST)]
            out.append(readings)
        return out

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest reading; exact over the states (last two letters), linear in the token."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for readings in self.lattice(token, spaced):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for text, extra in readings:
                    if not text or (text == " " and b == 0):
                        state, total, way = (a, b), cost + extra, path
                    else:
                        c = self.code.get(text, 0)
                        state, total, way = (b, c), cost + extra - self.logp[a][b][c], (path, text)
                    if state not in new or total < new[state][0]:
                        new[state] = (total, way)
            best = new
        _, path = min(((cost - self.logp[a][b][0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """A lower-case token as clean words: itself unless it looks written around."""
        core = token.strip(EDGE)
        if len(core) > 3 and core[-1] == core[-2] == core[-3] and not core[-1].isalpha():
            core = core.rstrip(core[-1])  # a run of signs behind a word is no letter
        if core.isalpha():
            return self.decode(core) if TWICE.search(core) else core
        if not any(map(str.isalpha, core)) and sum(c in LEET for c in core) < 3:
            return ""  # a number or marks
        return self.decode(core)

    def odd(self, piece: str) -> bool:
        """Is a short token unlikely to be a word of its own?"""
        core = piece.strip(EDGE)
        if not any(map(str.isalpha, core)):
            return False
        if not core.isalpha():
            return any(c in LEET for c in core)
        a, b = (self.code.get(core[-2], 0) if len(core) > 1 else 0), self.code.get(core[-1], 0)
        return self.logp[a][b][0] < ODD


def runs(tokens: list[str]) -> list[tuple[int, int]]:
    """Ranges of two or more tokens of at most ``SHORT`` characters in a row."""
    short = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) <= SHORT
    edges = np.flatnonzero(np.diff(short, prepend=False, append=False)).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a > 1]


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


class _Weights(dict):
    """Remembered evidence of written tokens."""

    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader

    def __missing__(self, token: str) -> float:
        weight = self[token] = max(map(self.reader.weight, self.reader.decoder.restore(token).split()), default=0.0)
        return weight


class _Odd(dict):
    """Remembered answers of ``Decoder.odd``."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, piece: str) -> bool:
        answer = self[piece] = self.decoder.odd(piece)
        return answer


class Reader:
    """Evidence of whole texts: per written token or odd run the weight of its restored words, remembered."""

    def __init__(self, decoder: Decoder, weights: dict[str, float] | None = None, limit: int = 250_000):
        self.decoder, self.weights, self.limit = decoder, weights or {}, limit
        self.memo, self.odd, self.joined = _Weights(self), _Odd(decoder), {}

    def odd_runs(self, tokens: list[str]) -> list[tuple[int, int]]:
        odd = self.odd
        return [(a, b) for a, b in runs(tokens) if any(map(odd.__getitem__, tokens[a:b]))]

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        plain = {w for t in set(tokens) for w in self.decoder.restore(t).split()}
        return plain.union(*(self.decoder.decode(" ".join(tokens[a:b]), True).split() for a, b in self.odd_runs(tokens)))

    def restored(self, text: str) -> str:
        tokens, out, at = text.lower().split(), [], 0
        for a, b in [*self.odd_runs(tokens), (len(tokens), len(tokens))]:
            out += [self.decoder.restore(t) for t in tokens[at:a]]
            if b > a:
                out.append(self.decoder.decode(" ".join(tokens[a:b]), True))
            at = b
        return " ".join(filter(None, out))

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def evidence(self, text: str) -> tuple[float, float]:
        """(log of the distinct words' summed weights, hits per thousand words on a log scale)."""
        if len(self.memo) + len(self.odd) + len(self.joined) > self.limit:
            self.memo.clear()
            self.odd.clear()
            self.joined.clear()
        memo, joined, tokens = self.memo, self.joined, text.lower().split()
        kinds = set(tokens)
        hits = list(filter(None, map(memo.__getitem__, kinds)))
        for a, b in self.odd_runs(tokens):
            run = " ".join(tokens[a:b])
            if run not in joined:
                joined[run] = [w for w in map(self.weight, self.decoder.decode(run, True).split()) if w]
            hits += joined[run]
        return math.log1p(sum(hits)), math.log1p(1000 * len(hits) / max(50, len(tokens)))


def _curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression on two columns by Newton's method; without both classes, the smoothed rate."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 10)
        return (math.log(p / (1 - p)), 0.0, 0.0)
    a, beta = np.hstack([np.ones((len(x), 1)), x]), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + penalty * np.eye(3)
        beta += np.linalg.solve(hessian, a.T @ (y - p) - penalty * beta)
    return tuple(map(float, beta))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 24_000, support: int = 4, least: float = 2.5) -> Model:
    """Learn from the texts of all rows (characters) and from labelled rows where ``train`` holds (``train`` is a Column over ``id``).

    The labelled sample is bounded: the ``sample_rows`` ids with the least hash; of an id
    with several rows the one with the least hash of the text counts. A feature counts if
    ``support`` toxic documents have it and its log odds reach ``least``; all such features
    are kept, whose number the sample bounds. The curve is fitted on the half of
    the sample that its features were not chosen on. An id labelled more than once
    is toxic if any of its labels is; null ids and labels are left out.
    """
    spark = docs.sparkSession
    table = trigram(character_counts(docs, text_col))
    shared = spark.sparkContext.broadcast(table)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(train)
    picked = marks.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "id")  # sample_rows ids
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = rows.select("text", "y", (F.xxhash64("id", F.lit("half")) % 2 == 0).alias("half"))

    def count(batches):
        import pyarrow as pa

        release()
        reader = Reader(Decoder(shared.value))
        got = [Counter() for _ in range(4)]
        for b in sliced(batches):
            for t, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[2 * half + y].update({f for w in reader.words(t) for f in features(w)})
        names = list(set().union(*got))
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([g[f] for f in some], pa.int64()) for g in got)], ["f", "c0", "t0", "c1", "t1"])

    sizes = {(bool(r.half), r.y): r.n for r in sample.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(count, "f string, c0 long, t0 long, c1 long, t1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))

    def odds(t: Column, c: Column, halves: tuple[bool, ...]) -> Column:
        toxic, clean = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
        value = F.log((t + 0.3) / (toxic + 1)) - F.log((c + 0.3) / (clean + 1))
        return F.when((t >= support) & (value >= least), value)

    both = counts.select("f", odds(F.col("t0"), F.col("c0"), (False,)).alias("half"), odds(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), (False, True)).alias("all"))
    kept = both.where("half IS NOT NULL OR `all` IS NOT NULL").collect()  # features of sample_rows texts
    half = {r.f: r["half"] for r in kept if r["half"] is not None}

    def judged(batches):
        import pyarrow as pa

        release()
        reader = Reader(Decoder(shared.value), half)
        for b in sliced(batches):
            x = [reader.evidence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1)], ["a", "b", "y"])

    seen = sample.where("half").select("text", "y").mapInArrow(judged, "a double, b double, y int").collect()  # at most sample_rows rows
    curve = _curve(np.array([(r.a, r.b) for r in seen]).reshape(-1, 2), np.array([r.y for r in seen], dtype=float))
    return Model(table, {r.f: r["all"] for r in kept if r["all"] is not None}, curve)


def _score(evidence: tuple[float, float], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * evidence[0] + curve[2] * evidence[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def judge(docs: DataFrame, model: Model, held_out: Column | None = None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text.

    A null or empty text has no evidence and gets the curve's score without any. Repeated
    rows give repeated results; an empty table gives no rows.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # SIZE ** 3 floats and the sample's features

    def task(batches):
        import pyarrow as pa

        m = shared.value
        reader = resident(("toxicity", name), lambda: Reader(Decoder(m.trigram), m.weights))
        for b in sliced(batches):
            s = [_score(reader.evidence(t or ""), m.curve) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; null and empty texts do unless nearly all labels are toxic.

    Repeated rows fare alike; an empty table gives no rows.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def task(batches):
        import pyarrow as pa

        m = shared.value
        reader = resident(("toxicity", name), lambda: Reader(Decoder(m.trigram), m.weights))
        for b in sliced(batches):
            yield b.filter(pa.array([_score(reader.evidence(t or ""), m.curve) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), residue("id", 3) != 1)
    return judge(docs, model, residue("doc_id", 3) == 1)
