"""Tasks, shuffle files and candidate pairs: many partitions and few rows."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quorumlake.llm import near, pitman_yor
from quorumlake.llm.common import components


def tasks(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    result = run()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    return result, sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)


def test_components_take_tasks_by_edges(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, n = tasks(spark, "components", lambda: components(edges).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.root for r in got} == {0} and len(got) == 201
    assert n < 2000


def files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}


def test_near_dedup_leaves_no_shuffle_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 7} of some few that say nothing more at all", "en") for i in range(60)], "doc_id long, text string, lang string")
    before = files(spark)
    corpus_pipeline.near_dedup(spark, docs, "").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert not files(spark) - before


def test_roomy_pairs_lose_no_similar_pair(spark):
    rng, sets = random.Random(5), []
    for _ in range(40):
        base = rng.sample(range(300), rng.randint(5, 40))
        sets += [sorted({*base[: len(base) - cut_], *rng.sample(range(300), extra)}) for cut_, extra in ((0, 0), (rng.randint(0, 4), rng.randint(0, 4)), (rng.randint(0, 9), 1))]
    rows = [(k, v, len(s), i, v) for v, s in enumerate(sets) for i, k in enumerate(s[: len(s) - -(-4 * len(s) // 5) + 1])]
    live = spark.createDataFrame(rows, "key long, node long, n int, i int, root long")
    got = {tuple(r) for r in near._roomy(live, (4, 5)).collect()}
    similar = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 5 * len(common := {*x} & {*y}) >= 4 * (len(x) + len(y) - len(common))}
    prefix = {v: {r[0] for r in rows if r[1] == v} for v in range(len(sets))}
    plausible = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 9 * (len(prefix[a] & prefix[b]) + -(-4 * max(len(x), len(y)) // 5) - 1) >= 4 * (len(x) + len(y))}
    assert len(similar) > 40 and similar <= got <= plausible


def test_large_near_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Texts that drifted from one by up to five words are linked by it; few are read in pairs, and no link is lost."""
    rng, texts = random.Random(6), []
    base = [f"w{x}" for x in rng.sample(range(5000), 150)]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(150), i % 6):
            w[at] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 9 * len(x & y) >= 4 * (len(x) + len(y))]
    root = list(range(300))
    for _ in range(300):
        old = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if old == root:
            break
    asked, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    nodes = spark.createDataFrame([(i, bytearray(t, "ascii")) for i, t in enumerate(texts)], "node long, text binary")
    found = {r.node: r.root for r in components(near.links(nodes.dropDuplicates(["text"]))).collect()}
    alike = {t: min(i for i, u in enumerate(texts) if u == t) for t in texts}
    groups = lambda of: sorted(sorted(v) for v in of.values())
    want, got = {}, {}
    for i, t in enumerate(texts):
        want.setdefault(root[i], set()).add(alike[t])
    kept = {r.node for r in nodes.dropDuplicates(["text"]).collect()}
    for i in kept:
        got.setdefault(found.get(i, i), set()).add(alike[texts[i]])
    assert groups(got) == groups(want)
    assert len(links) > 5000 and asked[-1] < 300


def test_pitman_yor_leaves_no_shuffle_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 7} of some few that say nothing more at all") for i in range(60)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = files(spark)
    pitman_yor.query(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    assert not files(spark) - before


def test_pitman_yor_pairs_are_numbered_alike_in_any_order():
    """A request and its scoring see a batch's texts in any order; answers know pairs by their places."""
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))).encode() for _ in range(50)] + [None, b""]
    names, tokens = pitman_yor._numbered(pa.array(texts, pa.binary()))
    again, turned = pitman_yor._numbered(pa.array(texts[::-1], pa.binary()))
    assert names == again == sorted(names) and [x.tolist() for x in tokens] == [x.tolist() for x in turned[::-1]]
    codes = pitman_yor._pair_codes(tokens)
    assert codes.tolist() == pitman_yor._pair_codes(turned).tolist()
    end, seen = pitman_yor.END_TOKEN, set()
    for t in texts:
        w = [end, *pitman_yor.words(t), end]
        seen |= set(zip(w[1:], w, strict=False))
    assert {(names[c >> 32], names[c & 0xFFFFFFFF]) for c in codes.tolist()} == seen


def test_pitman_yor_pairs_take_few_bytes(spark):
    """Pairs of words go and stay packed, by bucket: a row a pair took two numbers of 64 bits."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.random() ** 2 * 3000)}" for _ in range(300))) for i in range(200)], "doc_id long, text string")
    model = pitman_yor.fit(docs, batch_bytes=100_000)
    n = model.pairs.count()
    held = model.learned.merged.where("kind = 'pairs'").selectExpr("aggregate(parts, 0, (a, x) -> a + octet_length(x)) as n").agg(F.sum("n")).first()[0]
    assert n > 30_000 and held < 6 * n
    import numpy as np

    for x in ([], [0], [3, 70_000, 5], [-1, 1 << 62], list(range(1000))):
        assert pitman_yor.opened(pitman_yor.squeezed(np.array(x, dtype=np.int64))).tolist() == x
    assert pitman_yor.opened(pitman_yor.squeezed(np.array([0.1, -3e300]))).tolist() == [0.1, -3e300]
    for w in ([], [b"a"], [b" ", b"\xff"]):
        assert pitman_yor._parted(pitman_yor._joined(w)) == w
