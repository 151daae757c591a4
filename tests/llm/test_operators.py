"""Edge cases and brute-force versions of the ten corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import bpe, forest, language, near, packing, pii, pitman_yor, sharding, simhash, toxicity, voronoi
from quorumlake.llm.common import components, residue

LONG = "lorem ipsum dolor " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"), (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (3, "Der schnelle braune Fuchs springt heute über den faulen Hund am Fluss", "de"), (4, None, "en"), (5, "", None), (6, " \t\n ", "de"), (7, "12345 67890 !!!", None),
    (8, LONG, "en"), (None, "Ein Text ohne Nummer", "de"), (9, "x" * 30_000, "en"), (3, "Der schnelle braune Fuchs springt heute über den faulen Hund am Fluss", "de"), (10, "🙂 ünïcode  text  with   spaces\n\n end ", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with clashing extra columns."""
    extra = [(*r, "src", 1, "s", 0, "h", 1.0) for r in TEXTS]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score string, shard int, fp string, length double").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (8, 1, 1), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = dict(table(components(edges)))
    assert all(got[i] == 1 for i in range(1, 41)) and got[51] == got[50] == 50 and 60 not in got
    assert components(edges.limit(0)).count() == 0


def test_bpe(docs):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    c = bpe.coder(path, tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = sorted(((d, len(i := ref.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in TEXTS), key=repr)
    assert table(bpe.encode(docs, path, tokenizers.PATTERN, with_ids=False)) == want
    full = bpe.encode(docs, path, tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in full) == sorted((t or "").encode() for _, t, _ in TEXTS)
    assert bpe.encode(docs.limit(0), path, tokenizers.PATTERN).count() == 0


def test_bpe_random_texts():
    import random

    import tiktoken

    c = bpe.coder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(800):
        t = "".join(rng.choice(" \n\t'sstéöa漢1. \x1f  <|>") for _ in range(rng.randint(0, 60)))
        assert c.encode(t) == ref.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64).collect()
    want = Counter()
    for d, t, _ in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = Counter(rng.integers(1, 100, size=rng.integers(1, 400)).tolist())
        fixed, rest = packing.reduce(dict(counts), 100)
        used = Counter()
        for members, times in [*fixed, *packing.best_fit(rest, 100)]:
            assert sum(members) <= 100
            for s in members:
                used[s] += times
        assert used == counts
        bins = sum(t for _, t in [*fixed, *packing.best_fit(rest, 100)])
        assert bins <= math.ceil(sum(s * n for s, n in counts.items()) / 100 * 1.12) + 2
    assert packing.reduce({60: 2, 40: 1, 39: 1}, 100)[0][0] == ((60, 40), 1)


def test_sharding(docs):
    got = sharding.assign(docs, sharding.topology(24), sharding.topology(25)).collect()
    assert len(got) == len(TEXTS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in TEXTS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 for r in got)
    assert sharding.assign(docs.limit(0), sharding.topology(24), sharding.topology(25)).count() == 0


def test_sharding_weights(spark):
    tree = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 1, 1, 2.0), sharding.Shard(1, 0, 2, 1.0), sharding.Shard(1, 0, 3, 0.0)]
    heavier = [*tree[:2], sharding.Shard(1, 0, 2, 3.0), tree[3]]
    ids = spark.range(20_000)
    rows = ids.select(sharding.descend(F.col("id").cast("string"), tree).alias("a"), sharding.descend(F.col("id").cast("string"), heavier).alias("b")).collect()
    n = Counter(r.a for r in rows)
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and n[3] == 0
    assert all(r.a == r.b or r.b == 2 for r in rows)  # only the subtree whose weight grew takes rows


def test_language(docs, spark):
    model = language.fit(docs)
    assert set(model) == {"en", "de"}
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (7, "und"), (1, "en"), (3, "de")} <= got
    assert all(0 <= r.score <= 1 for r in language.identify(docs, model).collect())
    kept = language.keep(docs, model)
    assert kept.columns == docs.columns and {4, 5, 6, 7}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.fit(docs.limit(0)) == {} and language.identify(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_long_texts(spark, corpus):
    model = language.fit(corpus.where(residue("doc_id", 3) != 1))
    rng = np.random.default_rng(7)
    by: dict = {}
    for r in corpus.where(residue("doc_id", 3) == 1).where("lang is not null and text is not null").collect():
        by.setdefault(r.lang, []).extend(r.text.split())
    assert set(by) == set(model) and len(by) == 4
    rows = []
    for lang, words in sorted(by.items()):
        mean = sum(len(w.encode()) + 1 for w in words) / len(words)
        rows += [(len(rows) + k, lang, " ".join(rng.choice(np.array(words, dtype=object), int(size / mean)))) for k, size in enumerate((50_000, 5_000_000))]
    long = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    assert {r.doc_id for r in language.keep(long, model).select("doc_id").collect()} == {r[0] for r in rows}
    got = {r.doc_id: r for r in language.identify(long, model).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows)
    assert all(got[i + 1].margin > 0.7 * got[i].margin for i, _, _ in rows[::2])  # the same share at any length


def test_language_matches_the_whole_dictionary(corpus):
    """A level that indexes little of a dictionary has 96.1 % right and 25 rejected here."""
    rows = language.identify(corpus, language.fit(corpus.where(residue("doc_id", 3) != 1))).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in rows) >= 980 and sum(r.rejected for r in rows) <= 15


def test_simhash_groups(docs):
    got = table(simhash.group(docs).drop("fp"))
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t, _ in TEXTS}
    nodes = [(d, simhash.fingerprint((t or "").encode())) for d, t, _ in TEXTS]
    root = list(range(len(nodes)))
    for _ in nodes:
        for i, (_, a) in enumerate(nodes):
            for j, (_, b) in enumerate(nodes):
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((d for (d, _), q in zip(nodes, root, strict=True) if q == r and d is not None), default=None) for r in root}
    assert got == sorted(((d, f"{f & (1 << 64) - 1:016x}", least[r]) for (d, f), r in zip(nodes, root, strict=True)), key=repr)
    assert prints[4] == prints[5] == prints[6] == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x for x in least.values() for _ in [0] if x is not None and list(least.values()).count(x) == 1) | Counter({None: 1} if None in least.values() else {})
    assert simhash.group(docs.limit(0)).count() == 0
    one_id = docs.select(F.lit(7).cast("long").alias("doc_id"), "text", "n_chars")  # one id heads every component
    assert simhash.keep_one(one_id).count() == len(set(root)) and simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_links_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # the hot group then has keys above it, known to every task
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, size=40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, size=rng.integers(0, 7), replace=False)) for b in base for _ in range(8)]
    hot = [int(base[0]) ^ sum(1 << int(k) for k in rng.choice(12, size=rng.integers(0, 6), replace=False)) for _ in range(400)]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in (v & (1 << 64) - 1 for v in [*near, *hot, 0, -1])})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(table(components(simhash.links(nodes))))
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == fps[find(i)] for i, x in enumerate(fps))


def test_near_copies_against_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    common = " ".join(rng.choice(vocabulary, 30))
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(150, 500))))
        texts.append(" ".join(base))
        for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.08):
            w = list(base)
            for at in rng.choice(len(w), math.ceil(share * len(w)), replace=False):
                w[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
        texts += [" ".join(base).upper(), f"{common} {' '.join(rng.choice(vocabulary, 6))}", f"{common} {' '.join(rng.choice(vocabulary, 40))}"]
    texts += [texts[0], None, "", " \n", "one two", "One two", "three"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, node int").repartition(5)
    kept = near.keep_one(df)
    want = sorted(i for i in range(len(texts)) if find(i) == i)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(df).count() > len(want)  # 3 bits of 64 leave near copies
    assert near.keep_one(docs).columns == docs.columns and near.keep_one(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    rows = []
    for i in range(20):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        copy = [w if k % 100 else "changed" for k, w in enumerate(base)]  # 3 of 300 words: Jaccard 0.9
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], "x", 1) for i in range(300)]
    rows += [(i, [0.5] * 8, "x", 1) for i in range(300, 400)] + [(400, None, "x", 1), (401, [1.0, None], "x", 1), (402, [float("nan")] * 8, "x", 1), (403, [0.0] * 8, "x", 1), (404, [2.0, 1.0], "x", 1), (405, [], "x", 1), (None, [0.25] * 8, "x", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, score int")


def _brute(rows, mod, k, use):
    ok = [(i, use(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, v) for i, v in ok if v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    return {i: sorted(((-dot(v, w), j) for j, w in ok if j is not None and j != i), key=lambda x: x)[:k] for i, v in ok if i is not None and i % mod == 0}


def test_voronoi(vectors):
    data = vectors.where("vec_id is not null")
    got: dict = {}
    for r in voronoi.top_k(data, F.col("vec_id") % 50 == 0, pivots=6).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = _brute([(r.vec_id, r.embedding) for r in data.collect()], 50, 5, lambda v: [math.floor(256 * x) for x in v])
    assert {q: [(s, i) for _, s, i in sorted(h)] for q, h in got.items()} == want
    assert all([n for n, _, _ in sorted(h)] == list(range(1, len(h) + 1)) for h in got.values())
    assert voronoi.top_k(data.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi.top_k(vectors, F.col("vec_id") % 50 == 0).count() > 0
    assert voronoi.top_k(data.where("vec_id in (0, 1, 400)"), F.col("vec_id") % 50 == 0).count() == 1
    twice = data.union(data.where("vec_id < 100"))  # repeated rows
    assert voronoi.top_k(twice, F.col("vec_id") % 50 == 0).where("query_id = vec_id").count() == 0


def test_voronoi_sends_what_is_needed(spark):
    """On clustered vectors the bounds keep most candidates from a cell; the answer stays exact."""
    rng = np.random.default_rng(22)
    x = np.repeat(rng.standard_normal((30, 8)), 100, axis=0) + 0.05 * rng.standard_normal((3000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats: dict = {}
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in voronoi.top_k(rows, F.col("vec_id") % 50 == 0, block=8, chunk=500, pivots=40, stats=stats).collect()}
    y = np.floor(256 * x).astype(np.int64)
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -(1 << 60)
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(s[j], j) for j in best]
    assert stats["needed"] < 0.5 * stats["cells"] * 3000 and stats["sent"] < 0.8 * stats["groups"] * 3000 and stats["groups"] > 3


def test_voronoi_scores_what_cells_need(spark):
    """With default parameters all queries are one group; each is scored against its own cell's candidates only."""
    rng = np.random.default_rng(23)
    x = np.repeat(rng.standard_normal((20, 8)), 300, axis=0) + 0.05 * rng.standard_normal((6000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats: dict = {}
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in voronoi.top_k(rows, F.col("vec_id") % 50 == 0, stats=stats).collect()}
    y = np.floor(256 * x).astype(np.int64)
    for q in range(0, 6000, 50):
        s = y @ y[q]
        s[q] = -(1 << 60)
        best = np.lexsort((np.arange(6000), -s))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(s[j], j) for j in best]
    assert stats["groups"] == 1 and stats["scored"] == stats["pairs"] < 0.25 * stats["queries"] * 6000


def test_forest(vectors):
    data = vectors.where("vec_id is not null")
    got: dict = {}
    for r in forest.search(data, F.col("vec_id") % 20 == 0, k=20, trees=6, part=128, recall=0.98).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _brute([(r.vec_id, r.embedding) for r in data.collect()], 20, 20, lambda v: v if any(v) else None)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(abs(s + dict((i, w) for w, i in want[q]).get(i, -s)) < 1e-9 for q in want for _, i, s in got[q])
    assert forest.search(data.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = forest.search(data.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2
    twice = data.union(data.where("vec_id < 40"))  # repeated rows
    assert forest.search(twice, F.col("vec_id") % 20 == 0, k=3).where("query_id = vec_id").count() == 0


def test_forest_leaves_stay_unopened(spark):
    """Recall on clustered vectors with a budget of a small part of them; rows count once though several trees hold them."""
    rng = np.random.default_rng(21)
    x = np.repeat(rng.standard_normal((60, 16)), 100, axis=0) + 0.3 * rng.standard_normal((6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats: dict = {}
    got: dict = {}
    for r in forest.search(rows, F.col("vec_id") % 20 == 0, trees=8, part=1000, stats=stats).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert stats["vectors"] == 6000 and stats["budget"] < 0.3 * 6000
    hits = 0
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(ids))
        assert len(ids) == len(set(ids)) == 20
    assert hits >= 0.9 * 20 * 300 == 0.9 * 20 * len(got)


def test_forest_order_is_that_of_a_queue():
    import heapq

    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 6))
    trees = [forest.Tree(x, 10, np.random.default_rng(i)) for i in range(4)]
    f = forest.Forest(trees)
    for q, order in zip(x[:25], f.order(x[:25]), strict=True):
        queue = [(-np.inf, i, 0) for i in range(len(trees))]
        bounds = []
        while queue:
            bound, i, node = heapq.heappop(queue)
            yes, no = trees[i].child[node]
            if yes < 0:
                bounds.append((bound, int(f.first[i]) - 1 - int(yes)))
                continue
            wrong = float(trees[i].normal[node] @ q - trees[i].offset[node])
            heapq.heappush(queue, (max(bound, -wrong), i, int(yes)))
            heapq.heappush(queue, (max(bound, wrong), i, int(no)))
        by_leaf = {leaf: b for b, leaf in bounds}
        assert sorted(by_leaf) == list(range(f.first[-1]))
        assert np.allclose([by_leaf[leaf] for leaf in order.tolist()], [b for b, _ in bounds])
        assert int(f.route(q[None])[0, 0]) in {leaf for b, leaf in bounds if b <= 0}


def test_pitman_yor(docs):
    held = residue("doc_id", 10) == 0
    got = pitman_yor.score(docs, held).collect()
    assert len(got) == len(TEXTS)
    counts: Counter = Counter()
    for d, t, _ in TEXTS:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            counts.update([*pitman_yor.words((t or "").encode()), b" "])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t, _ in TEXTS:
        w = [*pitman_yor.words((t or "").encode()), b" "]
        want[(d, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.score(docs.limit(0), held).count() == 0


def test_pitman_yor_is_a_distribution(docs):
    """In every context the words and the unseen one sum to one."""
    m = pitman_yor.fit(docs)
    known = m.words.collect()
    unseen = m.root_unknown()
    for ctx in (32, ord("e"), ord("x"), 1):
        share, total = m.shares()[:, ctx], float((m.shares()[:, ctx] * unseen).mean())
        for r in known:
            seen = bytes(r.ctx).find(bytes([ctx]))
            total += 10.0 ** (-float(np.frombuffer(r.q, "<u2")[seen]) / pitman_yor.Q) if seen >= 0 else float((share * [r.one, r.two]).mean())
        assert abs(total - 1) < 3e-4


def test_pitman_yor_does_not_depend_on_partitions(docs):
    held = residue("doc_id", 10) == 0
    one, other = ({(r.doc_id, r.n_tokens): r.score for r in pitman_yor.score(docs.repartition(n), held, batch_bytes=size).collect()} for n, size in ((1, 1 << 24), (5, 20_000)))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) <= 1e-6 * abs(one[k]) for k in one)


def test_pitman_yor_learns_contexts(corpus):
    """The model beats the smoothed counts on training and on held-out texts."""
    rows = pitman_yor.score(corpus, residue("doc_id", 10) == 0).collect()
    for held in (True, False):
        some = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_seating_has_the_right_distribution():
    """Long runs of remove-and-seat moves against the exact distribution of the number of tables."""
    d, other, parent = 0.5, 7, 0.3
    for c in (2, 5, 8):
        exact = np.zeros(c + 1)

        def enumerate_seatings(sizes, weight, left, exact=exact):
            if not left:
                exact[len(sizes)] += weight
                return
            enumerate_seatings([*sizes, 1], weight * (pitman_yor.STRENGTH + d * (other + len(sizes))) * parent, left - 1)
            for i, n in enumerate(sizes):
                enumerate_seatings([*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - d), left - 1)

        enumerate_seatings([], 1.0, c)
        many = 30_000
        key = np.arange(many, dtype=np.uint64) << np.uint64(13)
        full = np.full(many, c)
        s = pitman_yor.Seating(key, full, np.ones(many, dtype=np.int64), full, full - 1, d)
        s.sweep(1, lambda at, t: (pitman_yor.STRENGTH + d * (other + t)) * parent)
        for _ in range(12):
            s.sweep(c, lambda at, t: (pitman_yor.STRENGTH + d * (other + t)) * parent)
        assert (s.c == c).all() and (np.add.reduceat(s.sizes(), np.cumsum(s.t) - s.t) == c).all()
        assert np.abs(np.bincount(s.t, minlength=c + 1) / many - exact / exact.sum()).max() < 0.015
        s.become(np.full(many, 1), lambda at, t: np.ones(len(at)))
        assert (s.t == 1).all()


def test_drawn_tables_have_the_exact_distribution():
    """Against every seating of few customers, and the sum for many customers against the table's recursion."""
    d, other, parent, many = 0.5, 7, 0.3, 60_000
    for c in (2, 5, 8):
        exact = np.zeros(c + 1)

        def enumerate_seatings(sizes, weight, left, exact=exact):
            if not left:
                exact[len(sizes)] += weight
                return
            enumerate_seatings([*sizes, 1], weight * (pitman_yor.STRENGTH + d * (other + len(sizes))) * parent, left - 1)
            for i, n in enumerate(sizes):
                enumerate_seatings([*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - d), left - 1)

        enumerate_seatings([], 1.0, c)
        got = np.bincount(pitman_yor.drawn_tables(np.arange(many, dtype=np.uint64), np.full(many, c), np.full(many, other), np.full(many, parent), d, 3), minlength=c + 1) / many
        assert np.abs(got - exact / exact.sum()).max() < 0.01
    for d in (0.37, 0.5, 0.66, 0.8):  # 0.5 j and 0.8 j are whole numbers at times
        table, row = pitman_yor.log_seatings(d)[4000, :64], pitman_yor._log_seatings_of_many(4000, d, 64)
        assert np.abs((table - table[0]) - (row - row[0])).max() < 1e-2
    large = pitman_yor.drawn_tables(np.arange(50, dtype=np.uint64), np.full(50, 10**7), np.full(50, 10**6), np.full(50, 0.05), 0.5, 1)  # beyond: as expected
    assert ((large > 64) & (large <= 10**7)).all()
    assert pitman_yor.drawn_tables(np.zeros(3, dtype=np.uint64), np.array([0, 1, 2]), np.zeros(3), np.zeros(3), d, 1).tolist() == [0, 1, 1]


def test_toxicity_restores():
    texts = ["you are an idiot and a moron truly", "the weather is nice and the sea is calm", "idiot moron stupid trash people talk"] * 50
    counts = np.zeros((toxicity.SIZE,) * 3)
    lut = {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}
    for t in texts:
        s = [lut.get(c, 0) for c in f"  {t}  "]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            counts[a, b, c] += 1
    r = toxicity.Reader(toxicity.Decoder(toxicity.trigram(counts)))
    assert r.restored("You 1d10t") == "you idiot"
    assert r.restored("m o r o n") == "moron"
    assert r.restored("stuuuupid tr@$h") == "stupid trash"
    assert r.restored("i.d.i.o.t &&& nice###") == "idiot nice"
    assert r.restored("12 !! ...") == ""
    assert r.restored("1d107 is") == "idiot is"
    assert r.restored("7r45h 57up1d") == "trash stupid" and r.restored("534") == "sea"  # also without any letter
    assert r.restored("id io t") == "idiot"  # pieces of several characters
    assert r.restored("iddiot") == "idiot" and r.restored("sea is calm") == "sea is calm"


def test_toxicity_decodes_exhaustively():
    """The Viterbi reading costs no more than the best of all readings."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 30, size=(toxicity.SIZE,) * 3).astype(float)
    d = toxicity.Decoder(toxicity.trigram(counts))

    def cost(path):
        a = b = 0
        total = 0.0
        for text, extra in path:
            total += extra
            if text and not (text == " " and b == 0):
                c = d.code.get(text, 0)
                total -= d.logp[a][b][c]
                a, b = b, c
        return total - d.logp[a][b][0], "".join(t for t, _ in path)

    import itertools

    for token in ("1d10t", "m0r0n", "aab", "a b c", "f*#k", "455", "ab.cd", "t t", "$#!7"):
        for spaced in (False, True):
            best = min(cost(p)[0] for p in itertools.product(*d.lattice(token, spaced)))
            got = d.decode(token, spaced)
            assert abs(min((c for c, t in map(cost, itertools.product(*d.lattice(token, spaced))) if " ".join(t.split()) == " ".join(got.split())), default=9e9) - best) < 1e-9


def test_toxicity_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "another text")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.judge(docs, toxicity.fit(docs, marks, F.lit(True), support=1)).count() == 51


def test_toxicity(docs, labels, spark):
    model = toxicity.fit(docs, labels, residue("id", 3) != 1)
    got = toxicity.judge(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.judge(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels.limit(0), residue("id", 3) != 1)
    assert toxicity.keep(docs, none).count() == len(TEXTS)
    bad, fine = "what an awful idiot you moron", "what a lovely day by the sea"
    many = spark.createDataFrame([(i, bad if i % 2 else fine) for i in range(200)] + [(1000, "what an awful 1d10t you m0r0n"), (1001, fine)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    judged = {r.doc_id: r.predicted for r in toxicity.judge(many, toxicity.fit(many, marks, residue("id", 3) != 1)).collect()}
    assert judged[1000] == 1 and judged[1001] == 0 and judged[1] == 1 and judged[0] == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 14 <= len(d) <= 19 and _luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_pii_base(spark, docs):
    rng = np.random.default_rng(4)
    parts = ["a@b.co", "x_y@z.org_d@e.fr", "é", " ", "1.2.3.4", "256.1.1.1", "001.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1 5 5 5 1 2 3 4 5 6 7", "🙂", "@", "..", "-", "+", "5", "1--23", "a@b@c.de", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 14))) for _ in range(300)] + ["1" * 50_000, "a" * 50_000, "a@" * 3000, "1.1.1.1 " * 500, "1 " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.extract(df)).collect()}
    for i, t in enumerate(texts):
        want = _base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i].n_email == want.count("email") and got[i].n_card == want.count("card")
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert pii.extract(docs).count() == len(TEXTS) and pii.extract(docs.limit(0)).count() == 0


def test_pii_discovers_and_masks(spark):
    seeds = [(i, f"please mail contact me user{i}@mail.org soon") for i in range(5)]
    hidden = [(10, "please mail contact me agent7@intranet now"), (11, "order number 12345 arrived"), (12, None)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in seeds + hidden], "doc_id long, text string, n_chars long, kind string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(df)).collect()}
    assert got[10] == "email:23:38" and got[11] == "" and got[12] == ""
    masked = pii.mask(df)
    assert masked.columns == df.columns
    by = {r.doc_id: r for r in masked.collect()}
    assert by[10].text == "please mail contact me [EMAIL] now" and by[11].text == hidden[1][1] and by[12].text is None
    assert by[0].text == "please mail contact me [EMAIL] soon" and by[0].n_chars == len(by[0].text)


def _plain_bootstrap(edges, rounds, support, confidence):
    seeds = {m: k for _, m, k in edges if k}
    accepted: dict = {}
    by: dict = {}
    for p, m, _ in edges:
        by.setdefault(p, set()).add(m)
    for _ in range(rounds):
        known = {m: (k, 1.0) for m, k in seeds.items()} | {m: x for m, x in accepted.items() if m not in seeds}
        patterns = {}
        for p, ms in by.items():
            for kind in pii.KINDS:
                hit = [known[m][1] for m in ms if m in known and known[m][0] == kind]
                if len(hit) >= support and sum(hit) / len(ms) >= confidence:
                    patterns[p, kind] = sum(hit) / len(ms)
        new: dict = {}
        for p, kind in patterns:
            for m in by[p] - set(seeds):
                new.setdefault(m, {}).setdefault(kind, []).append(patterns[p, kind])
        accepted = {}
        for m, kinds in new.items():
            score = {k: 1 - math.prod(1 - min(0.99, x) for x in v) for k, v in kinds.items()}
            kind = max(pii.KINDS, key=lambda k: score.get(k, 0))
            if score[kind] >= confidence:
                accepted[m] = (kind, score[kind])
    return accepted, patterns


def test_pii_rounds_against_plain_graph(spark):
    rng = np.random.default_rng(9)
    rows = {(f"p{rng.integers(12)}", f"m{i}", None) for i in range(60) for _ in range(3)}
    seeds = {f"m{i}": pii.KINDS[i % 2] for i in range(25)}
    rows = sorted({(p, m, seeds.get(m)) for p, m, _ in rows} | {("chain", f"m{i}", None) for i in (30, 31, 32, 33)} | {("good", f"m{i}", seeds.get(f"m{i}")) for i in (0, 2, 4, 6, 8, 10, 12, 30, 31, 32)}, key=repr)
    graph = spark.createDataFrame(rows, "pattern string, m string, kind string").repartition(3)
    for rounds in (1, 4):
        accepted, patterns = pii.bootstrap(graph, rounds=rounds)
        a, p = _plain_bootstrap(rows, rounds, 3, 0.6)
        assert {r.m: (r.kind, round(r.score, 9)) for r in accepted.collect()} == {m: (k, round(x, 9)) for m, (k, x) in a.items()}
        assert {(r.pattern, r.kind): round(r.score, 9) for r in patterns.collect()} == {k: round(x, 9) for k, x in p.items()}
    assert "m33" in a and len(a) >= 4  # reached through a pattern without a seed
    assert pii.bootstrap(graph.limit(0))[0].count() == 0


def test_pii_two_step_chain(spark):
    """Seeds give a pattern, it gives instances, they give a pattern of their own, which gives one more instance."""
    rows = [(i, f"please write to user{i}@mail.org soon") for i in range(6)]
    rows += [(10 + i, f"please write to agent{i}@intranet soon") for i in range(3)]
    rows += [(20 + i, f"the desk of agent{i}@intranet is closed") for i in range(3)] + [(30, "the desk of agent9@intranet is closed"), (31, "the colour of room-12345 was grey")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(df)).collect()}
    assert got[30] == "email:12:27" and got[31] == "" and got[10] == "email:16:31"
    once = {r.doc_id: r.spans for r in pii.digest(pii.extract(df, rounds=1)).collect()}
    assert once[30] == "" and once[10] == "email:16:31"


def test_pii_many_matches(spark):
    """Runs over several levels of blocks, and masks over several chunks."""
    rng = np.random.default_rng(6)
    words = ["a@b.co", "word", "🙂", "x1", "1.2.3.4", "(c@d.org),", "\n", "+1 555 123 4567"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 70, 5000, 30_000)] + ["a@b.co " * 9000, ("y" * 5000 + " a@b.co ") * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.extract(df)).collect()}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(_base(t).encode()).hexdigest()
        ends, out, at = 0, [], 0
        for kind, a, z in sorted((x.split(":") for x in got[i].spans.split(",") if x), key=lambda x: (int(x[1]), pii.KINDS.index(x[0]))):
            a, z = int(a), int(z)
            if a >= ends:
                out += [t[at:a], f"[{kind.upper()}]"]
            ends = at = max(ends, z)
        assert masked[i] == "".join(out) + t[at:]


def test_pii_covered_slots(spark):
    """No slot that touches a base span is free, all others of five characters are."""
    rng = np.random.default_rng(8)
    words = ["a@b.co", "(a@b.co),", "room-1234", "id:77777", "4111 1111 1111 1111", "4111 1111 1111 1111,", "tel:+1 (555) 123-4567", "x", "1.2.3.4/24", "12", "mail=u@v.org;w@x.org"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.spans(df).collect():
        t = texts[r.doc_id]
        want = []
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:\x20[().0-9-]+(?!\S))*", t):
            lead = len(re.match(r"[(\[{<\"'=:]*", m.group()).group())
            core = re.sub(r"^[(\[{<\"'=:]+|[)\]}>\"',;:.!?]+$", "", m.group())
            s, e = m.start() + lead, m.start() + lead + len(core)
            if len(core) >= 5 and not any(b.s < e and s < b.e for b in r.base):
                want.append((s, e, core.lower()))
        assert [(x.s, x.e, x.m) for x in r.slots] == want
        assert len(r.seeds) == len(r.base)


def test_voronoi_against_sql(spark):
    import duckdb

    from quorumlake.llm import registry

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(registry.oracle_sql()["op2_voronoi_top_k"])
    got = registry.queries()["op2_voronoi_top_k"](spark, "/root/testdata/sf0.001")
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pitman_yor_contexts_are_whole_words(spark):
    """Which word follows is told by the whole word before it: their endings are all alike."""
    rng = random.Random(5)
    follows = {"xa": "one", "ya": "two", "za": "six", "va": "ten"}  # every other word ends alike, and so do all contexts
    line = lambda swap: " ".join(f"{w} {follows[rng.choice(sorted(follows)) if swap else w]}" for w in (rng.choice(sorted(follows)) for _ in range(60)))
    rows = [(i, line(False)) for i in range(200)] + [(1000 + i, line(False)) for i in range(20)] + [(2000 + i, line(True)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pitman_yor.score(docs, F.col("doc_id") >= 1000).collect()
    mean = lambda low, high: sum(r.score / r.n_tokens for r in got if low <= r.doc_id < high) / sum(low <= r.doc_id < high for r in got)
    assert mean(1000, 2000) > -0.36  # the four leads are log10(4) / 2 = 0.30 a token, what follows is sure
    assert mean(2000, 3000) < mean(1000, 2000) - 0.5  # by endings these are as likely as the others
    assert all(abs(r.base_score / r.n_tokens + 0.9) < 0.1 for r in got)


def test_pitman_yor_whole_words_are_a_distribution(docs):
    """In the restaurant of every whole word its parts for seen words and its parent's share sum to one."""
    m = pitman_yor.fit(docs)
    d = m.discount[2]
    ids = {pitman_yor.word_id(bytes(r.word)): r for r in m.words.collect()}
    part = Counter()
    for r in m.pairs.collect():
        assert r.c >= r.t >= 1 and r.w in ids
        part[r.u] += (r.c - d * r.t) / (pitman_yor.STRENGTH + ids[r.u].guests)
    assert part and all(abs(p + (pitman_yor.STRENGTH + d * ids[u].tables) / (pitman_yor.STRENGTH + ids[u].guests) - 1) < 1e-9 for u, p in part.items())
    assert m.tokens == sum(r.c for r in ids.values()) == sum(r.guests for r in ids.values())
