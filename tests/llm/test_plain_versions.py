"""Plain versions of placement, language decisions and packing plans."""

import math
import random
from collections import Counter

import xxhash

from quorumlake.llm import language, packing, sharding


def test_placement_is_that_of_the_plain_tree(spark):
    def plain(key, tree):
        members, path = [s for s in tree if s.weight > 0], ""
        for depth in range(3):
            groups = {}
            for s in members:
                groups.setdefault(s[depth], []).append(s)

            def draw(g, path=path, groups=groups):
                h = xxhash.xxh64_intdigest(f"{path}/{g}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
                return -math.log(((h >> 11) + 0.5) / (1 << 53)) / sum(s.weight for s in groups[g])

            best = min(groups, key=draw) if len(groups) > 1 else next(iter(groups))
            members, path = groups[best], f"{path}/{best}"
        return members[0].shard

    even, grown = sharding.topology(24), sharding.topology(25)
    odd = [s._replace(weight=(0.0, 0.5, 1.0, 4.0)[s.shard % 4]) for s in even]
    df = spark.range(300).selectExpr("id AS doc_id", "'t' AS text")
    for tree in (even, odd):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(df, tree, grown).collect()}
        assert got == {i: (plain(str(i), tree), plain(str(i), grown)) for i in range(300)}
    assert all(g in (s, 24) for s, g in ((plain(str(i), even), plain(str(i), grown)) for i in range(300)))


def test_language_decisions_by_plain_compression():
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "mnopqrst"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = {lang: text(lang, 3000).encode() for lang in words}
    compressors = language._compressors(*language._run(model, 9))
    for lang in words:
        for n in (5, 60, 4000):
            t = text(lang, n)
            sizes = {}
            for name, c in compressors:
                raw = t.encode()
                sizes[name] = sum(len(c.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK))
            order = sorted(sizes, key=lambda x: (sizes[x], x))
            got = language.decide(t, compressors, 0.002)
            assert got[0] == order[0] and math.isclose(got[2], (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]])
            assert n < 60 or got[0] == lang and not got[3]
    same = language._compressors(*language._run({"bb": model["aa"], "aa": model["aa"]}, 9))
    assert language.decide(text("aa", 50), same, 0.002)[:1] == ("aa",) and language.decide(text("aa", 50), same, 0.002)[2:] == (0.0, True)  # a tie: first by name, rejected
    mixed = " ".join(rng.choice(words[lang]) for _ in range(400) for lang in ("aa", "bb"))
    margin = language.decide(mixed, compressors, 0.0)[2]
    assert not language.decide(mixed, compressors, margin)[3] and language.decide(mixed, compressors, margin + 1e-6)[3]
    assert all(language.decide(t, compressors, 0.002) == ("und", 0.0, 0.0, True) for t in (None, "", "12 !?"))


def test_packing_of_document_lengths_is_near_the_bound():
    rng = random.Random(7)
    for _ in range(5):
        counts = Counter(min(1024, max(1, int(rng.expovariate(1 / 300)))) for _ in range(4000))
        fixed, rest = packing.reduce(dict(counts), 1024)
        used, bins = Counter(), 0
        for members, times in [*fixed, *packing.best_fit(rest, 1024)]:
            assert sum(members) <= 1024
            bins += times
            for s in members:
                used[s] += times
        assert used == counts and bins <= math.ceil(sum(s * n for s, n in counts.items()) / 1024 * 1.01) + 1
