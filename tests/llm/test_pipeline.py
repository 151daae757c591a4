"""The whole chain on planted rows against plain Python, stage by stage."""

import math
import random
import re

import public_tokenizers as tokenizers
import pytest

import corpus_pipeline
from quorumlake.llm import language, toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, score string, h int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of sf0.01 with copies at a Jaccard similarity of 0.8 to 0.95, toxic copies, nulls, letterless texts, repeats and clashing columns."""
    path, rng = tmp_path_factory.mktemp("pipeline"), random.Random(8)
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    toxic, clean = {i for i, _, y in labels if y}, {i for i, _, y in labels if y == 0}
    long = [d for d in docs if d[1] and len(d[1].split()) > 120 and d[0] not in toxic]
    extra = []
    for i, d in enumerate(rng.sample(long, 12)):
        words = d[1].split()
        for at in rng.sample(range(len(words)), max(1, len(words) * (1 + i % 3) // 200)):
            words[at] = f"changed{at}"
        extra.append((100_000 + i, " ".join(words), d[2], "s", 0))
    extra += [(200_000 + i, d[1] + " ", d[2], "s", 0) for i, d in enumerate(d for d in docs if d[0] in toxic and d[1])][:10]
    extra += [(300_000, None, "en", None, None), (300_001, "", None, "s", 0), (300_002, "123 !!", "de", "s", 6), docs[5], (None, docs[6][1], docs[6][2], "s", 0), (300_003, "Write to ann.b@example.org or call +49 30 1234 5678 about the and of the thing in the house with them", "en", "s", 0)]
    spark.createDataFrame([(*d, 7, "x", 3) for d in docs + extra], COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), toxic, clean


def near_groups(rows):
    """Row numbers that stay: the least id of each group of near copies."""
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root, by = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in by.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            by[x].append(i)
        for j, c in common.items():
            if 9 * c >= 4 * (len(s) + len(sets[j])):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        best[find(i)] = min(best.get(find(i), (key, i)), (key, i))
    return [i for _, i in best.values()]


def test_chain_against_plain_python(spark, folder):
    from tokenizers import Tokenizer

    path, toxic, clean = folder
    docs, after = spark.read.parquet(f"{path}/documents.parquet"), {}
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.stored(stage(spark, state, path))
        after[name] = state
    plain = lambda df: [r.asDict() for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))

    # language: every row's decision by the compressors themselves
    model = language.fit(docs.where(corpus_pipeline.residue("doc_id", 3) != 1))
    compressors = language._compressors(*language._run(model, 9))
    want = [r for r in plain(docs) if not language.decide(r["text"], compressors, 0.002)[3]]
    first = plain(after["language_id"])
    assert sorted(map(key, first)) == sorted(map(key, want)) and after["language_id"].columns == docs.columns
    assert not {300_000, 300_001, 300_002} & {r["doc_id"] for r in first} and len(first) > 900

    # toxicity: every row's score by the reader itself; most toxic rows go, clean ones stay
    tone = toxicity.fit(after["language_id"], spark.read.parquet(f"{path}/labels.parquet"), corpus_pipeline.residue("id", 3) != 1)
    reader = toxicity.Reader(toxicity.Decoder(tone.trigram), tone.weights)
    second = plain(after["toxicity"])
    assert sorted(map(key, second)) == sorted(key(r) for r in first if toxicity._score(reader.evidence(r["text"] or ""), tone.curve) < 0.7)
    left = {r["doc_id"] for r in second}
    bad, good = [r for r in first if r["doc_id"] in toxic], [r for r in first if r["doc_id"] in clean - toxic]
    assert sum(r["doc_id"] in left for r in bad) <= 0.3 * len(bad) and sum(r["doc_id"] in left for r in good) >= 0.99 * len(good)

    # near copies: brute force over all shingle sets
    stays = near_groups(second)
    third = plain(after["simhash_near_dedup"])
    assert sorted(key({**r, "source": "", "n_chars": 0}) for r in third) == sorted(key({**second[i], "source": "", "n_chars": 0}) for i in stays)
    assert len(third) < len(second)

    # personal data: all rows are there, no base pattern is left
    fourth = plain(after["pii"])
    assert sorted((r["doc_id"] or -1) for r in fourth) == sorted((r["doc_id"] or -1) for r in third)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "") for r in fourth)
    masked = next((r for r in fourth if r["doc_id"] == 300_003), None)
    assert masked is None or masked["text"].startswith("Write to [EMAIL] or call [PHONE]") and masked["n_chars"] == len(masked["text"])

    # packing: every token once, in order, sequences full and gapless
    enc = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    enc.encode_special_tokens = True
    sizes = {}
    for r in fourth:
        n = len(enc.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        sizes.setdefault(r["doc_id"], []).append(n)
    pieces = plain(after["best_fit_packing"])
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {d: sum(n) for d, n in sizes.items()}
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert len(places) <= math.ceil(sum(total.values()) / 1024) * 1.01 + 1


def test_run_is_the_chain_and_removes_its_tables(spark, folder, monkeypatch):
    made = []
    stored = corpus_pipeline.stored

    def kept(df):
        made.append(stored(df))
        return made[-1]

    monkeypatch.setattr(corpus_pipeline, "stored", kept)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, p: d.where("doc_id < 50")), ("b", lambda s, d, p: d.where("doc_id < 9")), ("c", lambda s, d, p: d.select("doc_id"))])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder[0]).collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert len(made) == 2
    with pytest.raises(Exception, match="(?i)not exist|no such file|not_exist"):
        made[0].collect()  # its successor has been stored
    assert made[1].count() > 0


def test_stages_take_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, folder[0])
        assert got.count() == 0, name


def test_near_copies_come_by_simhash_first(spark, monkeypatch):
    """SimHash links nodes whose fingerprints differ in few bits; the join by prefixes gets what it leaves, and only that."""
    from pyspark.sql import functions as F

    from quorumlake.llm import near, simhash

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(900)]
    close, far = list(base), list(base)
    close[450] = "other"
    for at in range(20, 900, 45):  # 20 words: Jaccard about 0.8
        far[at] = f"changed{at}"
    texts = [" ".join(w).encode() for w in (base, close, far, [f"v{rng.randrange(5000)}" for _ in range(900)])]
    prints = [simhash.fingerprint(t, 5) & (1 << 64) - 1 for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.TAU < (prints[0] ^ prints[2]).bit_count()
    nodes = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "node long, text binary")
    assert [tuple(r) for r in near.simhash_pairs(nodes, 5).collect()] == [(0, 1)]
    asked, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *rest: asked.append(sorted(tuple(r) for r in pairs.select("a", "b").collect())) or confirmed(pairs, *rest))
    found = near.links(nodes, 5, (7, 10)).select(F.least("a", "b"), F.greatest("a", "b")).collect()
    assert asked[0] == [(0, 1)] and (0, 1) in map(tuple, found) and (0, 1) not in sum(asked[1:], [])
    assert {2} <= {x for r in found for x in r} and 3 not in {x for r in found for x in r}


def test_stages_hand_texts_to_workers_in_small_batches(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    try:
        import pyarrow as pa

        for name, stage in corpus_pipeline.STAGES:
            if name != "pii":  # no Python workers
                spark.conf.set(key, "10000")
                stage(spark, spark.read.parquet(f"{folder[0]}/documents.parquet").limit(3), folder[0])
                sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
                assert max(r.n for r in sizes.collect()) <= 1000, name
    finally:
        spark.conf.unset(key)
