"""Brute-force versions, SQL and edge cases of operators 11 to 13."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import collocations, contamination, conversations

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("module", [contamination, collocations])
def test_against_sql(spark, duck, module):
    got, want = module.query(spark, SF), duck.sql(module.SQL)
    assert got.columns == want.columns
    assert rows(got) == sorted(want.fetchall(), key=repr)


# ---- 11


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for trial in range(150):
        s = np.append(rng.integers(0, 4, rng.integers(0, 60)), 0)
        if trial % 10 == 0:  # many copies of a run
            s = np.append(np.tile(np.append(s[:30], 0), 5), 0)

        def suffix(i, s=s):
            return tuple(s[i : i + int(np.argmin(s[i:] > 0))].tolist())

        assert contamination.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: (suffix(i), i))
        index = contamination.FmIndex(s, step=4)
        lengths = rng.integers(1, 5, 20)
        phrases = rng.integers(1, 4, (20, 4)) * (np.arange(4) < lengths[:, None])
        for p, n, lo, hi in zip(phrases, lengths, *index.search(phrases, lengths), strict=True):
            want = [i for i in range(len(s)) if s[i : i + n].tolist() == p[:n].tolist()]
            assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


def brute_hits(text, items, width):
    words = [(m.group(), m.span()) for m in contamination.WORD.finditer(text or "")]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w, _ in words]
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), item or ""))
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(low) - size + 1 if size else 0):
            if tuple(low[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found |= {name} - {None}
    spans = []
    for i in sorted(hit):
        if i - 1 in hit:
            spans[-1][1] = words[i][1][1]
        else:
            spans.append(list(words[i][1]))
    return len(low), len(hit), sorted(found), spans


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "Ba", "c1", "dé", "e", "f"])
    items = [(str(i), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(12)] + [("4", "Ab; ba! C1"), (None, "e e dé e e"), ("9", None), ("10", "...")]
    docs = [(i, " ".join(word() + rng.choice(["", "", ".", " -", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(None, "x AB ba c1 y"), (7, None), (7, None), (8, ""), (9, "🙂 Ab--ba 🙂 c1"), (3, "e " * 9000 + "dé e e"), (11, "z " * 5000)]
    return items, docs


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_decontamination(spark, leaks, monkeypatch, block):
    monkeypatch.setattr(contamination, "TEXT", 500)
    items, docs = leaks
    own = spark.createDataFrame([(*r, 1, "n") for r in docs], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items + items[:2]], "item_id string, text string, doc_id string")
    got = contamination.find(own, bench, width=4, block=block)
    want = [(d, *brute_hits(t, items, 4)) for d, t in docs]
    got = [(r.id, r.n_words, r.n_hit, r["items"], [[s.start, s.end] for s in r.spans]) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want) and contamination.find(own, bench.limit(0), width=4).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination.find(own.limit(0), bench).count() == 0


def test_shards_overlap(leaks, monkeypatch):
    items, docs = leaks
    monkeypatch.setattr(contamination, "SHARD", 16)
    windows = contamination.Windows([(n, (t or "").encode()) for n, t in items], 4)
    for _, text in docs[:60]:
        got = contamination._found([(text or "").encode()], [[]], windows)[0]
        n, hit, names, spans = brute_hits(text, items, 4)
        assert (got[0], got[1], got[2], [[s["start"], s["end"]] for s in got[4]]) == (n, hit, names, spans)


def test_spans_are_cut_out(spark):
    df = spark.createDataFrame([("ab🙂cd ef", [(2, 5), (6, 7)]), ("x", [])], "text string, spans array<struct<start: long, end: long>>")
    assert [r[0] for r in df.select(contamination.without(F.col("text"), F.col("spans"))).collect()] == ["ab f", "x"]


# ---- 12

OK = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Every sequence of edits, as long as it can still be the cheapest: (cost, audit, repaired text), and each row's fault."""
    seen, faults = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None

    def go(i, cost, audit, initials, out, inserted):
        nonlocal best
        if best is not None and cost > best[0] or not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(turns) and OK.fullmatch(initials):
            best = min(best or (math.inf,), (cost, audit, "\n".join(out)))
        if i < len(turns):
            (role, text), cut = turns[i], faults[i] == "truncated"
            go(i + 1, cost + 3, audit + "D", initials, out, inserted)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, cost + cut, audit + "K", initials + (role[:1] or "?"), [*out, f"{role}:{text}"], inserted)
                for new in ("user", "assistant"):
                    go(i + 1, cost + cut + 2, audit + "R", initials + new[0], [*out, f"{new}:{text}"], inserted)
        if inserted < 3:
            for new in ("user", "assistant"):
                go(i, cost + 2, audit + "I", initials + new[0], [*out, f"{new}:"], inserted + 1)

    go(0, 0, "", "", [], 0)
    return best, faults


def test_repair_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(800):
        roles = ["user", "assistant", "system"] if rng.random() < 0.8 else ["user", "assistant", "system", "tool", " ", "", "s", "admin"]
        turns = [(rng.choice(roles), rng.choice(["a.", "b", "c!", " ", "a."])) for _ in range(rng.randint(0, 5))]
        best, _ = cheapest(turns)
        one = conversations.Repair()
        for role, text in turns:
            one.row(None, role, text)
        got = one.result()
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (*best[:2], hashlib.sha256(best[2].encode()).hexdigest())
        assert "\n".join(f"{r}:{t}" for _, r, t in conversations.replayed(turns, got["audit"])) == best[2]


@pytest.mark.parametrize("prime", [3, conversations.PRIME])  # with 3, hashes collide all the time
def test_audits_compare_as_texts(prime):
    rng, audit = random.Random(2), conversations.Audit(prime)
    nodes = [0]
    for _ in range(1500):
        nodes.append(audit.add(rng.choice(nodes[-30:]), rng.choice("DIKR")))
    for _ in range(5000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audit.less(a, b) == (audit.text(a) < audit.text(b))
    assert audit.text(audit.prefix(nodes[-1], 3)) == audit.text(nodes[-1])[:3]


def test_repair(spark):
    turns = [
        (1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 4, "assistant", "a."), (2, 0, "user", "q"), (2, 1, "user", "q"), (2, 2, "user", " \n"), (3, None, None, None), (3, 5, "user", "x."), (3, 5, "user", "x."),
        (None, 1, "assistant", "a."), (None, None, "user", "u."), (4, 0, "tool", "t."), (5, 0, "user", "x" * 100_000), (5, 1, "assistant", "y" * 100_000 + "."),
    ]
    df = spark.createDataFrame([(*t, "n", 1) for t in turns], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = {r.conv: r.asDict() for r in conversations.repair(df).collect()}
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or " ", t[3] or " "))
        (cost, audit, text), faults = cheapest([(t[2] or " ", t[3] or " ") for t in own])
        known = [t[1] for t in own if t[1] is not None]
        initials = [(t[2] or " ")[:1] for t in own]
        want[conv] = {"conv": conv, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(a + b not in {"su", "ua", "au"} for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
    assert got == want and got[1]["gaps"] == 2 and got[2]["duplicate"] == 1
    lines = {}
    for r in sorted(conversations.rewritten(df).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == x["repaired_sha256"] for c, x in want.items())
    assert conversations.repair(df.limit(0)).count() == 0


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = conversations.damaged(df)
    import zlib

    want = Counter()
    for c, t, r, x in map(tuple, df.collect()):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if kind == 4 else r or " ", "" if kind == 1 else "One Two" if kind == 2 else x or " "
        want[c, t, r, x, kind == 0] += 2 if kind == 3 else 1
    assert Counter(map(tuple, got.collect())) == want
    assert {r.conv for r in conversations.repair(got).collect()} == {*range(40), None}


# ---- 13


def plain_counts(docs, longest):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    return n, f


def plain_phrases(docs, least, longest, first, cover):
    n, f = plain_counts(docs, longest)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in n:
        kept = []
        for (own, w), a in often.items():
            longer = [b for (x, v), b in often.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if own != lang or any(100 * b >= cover * a for b in longer):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(9)
    words = ["Ab", "ba", "c", "dé", "🙂", "e-e", "ü", "zz"]
    docs = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words[: rng.choice([3, 8])]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(rng.randint(0, 50)))) for _ in range(200)]
    return [*docs, ("en", None), ("en", ""), ("fr", " .,;"), ("en", "ab ba c " * 3000), ("en", "ab ba c " * 3000)]


@pytest.mark.parametrize(("cover", "longest", "first"), [(100, 5, 2000), (60, 4, 7), (100, 2, 5)])
def test_collocations(spark, phrases, monkeypatch, cover, longest, first):
    for name, value in (("TEXT", 300), ("HELD", 40)):
        monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(phrases)], "doc_id long, lang string, text string, n long, phrase string").repartition(3)
    got = collocations.mine(df, least=12, longest=longest, first=first, cover=cover, bits=1 << 12)
    want = plain_phrases(phrases, 12, longest, first, cover)
    assert rows(got) == want and len(want) > 8
    assert collocations.mine(df.limit(0)).count() == 0


def test_crowded_bit_table_loses_nothing(spark, phrases):
    df = spark.createDataFrame(phrases, "lang string, text string")
    assert rows(collocations.mine(df, least=12, bits=64)) == plain_phrases(phrases, 12, 5, 2000, 100)


def test_scores_are_exact(spark, monkeypatch):
    big = 10**14
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    found = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 7), ("en", "b", 3 * big + 1)], "lang string, phrase string, a long")
    monkeypatch.setattr(collocations, "counted", lambda *a: (totals, found))
    got = collocations.mine(found, least=2).first()
    assert got.score == 1000 * big * 9 * 10**15 // ((big + 7) * (3 * big + 1))


def test_hat_trie():
    rng = np.random.default_rng(4)
    trie, want = collocations.HatTrie(burst=20), Counter()
    got = Counter()
    for _ in range(30):
        for m in (2, 3, 5):
            grams = rng.integers(1, 6, (200, m))
            trie.add(grams)
            want.update(map(tuple, grams.tolist()))
        if len(trie) > 1500:
            for part, n in trie.spill(700):
                got.update({tuple(p): int(c) for p, c in zip(part.tolist(), n, strict=True)})
            assert len(trie) <= 700
    for part, n in trie.spill():
        for p, c in zip(part.tolist(), n, strict=True):
            got[tuple(p)] += int(c)
    assert got == want and len(trie) == 0
