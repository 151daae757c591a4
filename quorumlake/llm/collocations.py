"""Operator 13: phrase collocation mining by HAT-trie counting.

Every task counts phrases in a HAT-trie: a trie over word numbers of at most two levels,
whose leaves are hash containers from the rest of a phrase to its count. A container that
gets large bursts into one container for each next word. When the trie holds too many
phrases, its largest subtrees leave it as sorted runs, and at the task's end the rest
does. Runs are merged in partitions of the prefix, a phrase's first two words.

A phrase is as frequent as asked only if all of its parts are. So words are counted
first, then pairs of frequent words, then longer phrases in chains of frequent pairs.
Before pairs are counted apart, their hashes are counted in a table of at most ``bits``
counters; pairs whose counter stays low are left out. What may be frequent reaches the
tasks as a bit table of at most ``bits`` bits, whatever the number of words and pairs: a
wrong hit lets a phrase be counted that the threshold drops later, never the reverse.
(On a corpus of far more than a hundred words a bit the tables are full; results are the
same, and runs hold all pairs of frequent words.) Word numbers are a task's own; runs
hold the words themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, stored

TEXT = 8 << 20  # bytes of texts that are cut into words together
HELD = 1_000_000  # phrases of a trie, words of a task, beyond which they spill
#: A-Z become lower case, what ends a piece a line feed, a tab a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
BREAK = b"."  # no word is this


def words(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of the texts in lists, with ``BREAK`` between pieces and texts."""
    plain, at = b"\n".join((*texts, b"")).translate(PLAIN), 0
    while at < len(plain):
        to = plain.find(b" ", at + TEXT)
        to = to if to >= 0 else len(plain)
        yield plain[at:to].replace(b"\n", b" . ").split()
        at = to


class HatTrie:
    """Counts of phrases of two and more word numbers."""

    def __init__(self, burst: int = 4096):
        self.burst = burst
        self.roots: dict[int, dict[int, dict]] = defaultdict(dict)  # by length and first word

    def add(self, phrases: np.ndarray) -> None:
        """Count each row of ``phrases`` once."""
        length = phrases.shape[1]
        root = self.roots[length]
        phrases = phrases[np.argsort(phrases[:, 0] << 32 | phrases[:, 1], kind="stable")]
        keys = _packed(phrases[:, 1:])
        for first, start, stop in _groups(phrases[:, 0]):
            node = root.get(first)
            if node is None:
                node = root[first] = {}
            if isinstance(node, _Burst):
                for second, a, b in _groups(phrases[start:stop, 1]):
                    _count(node.setdefault(second, {}), [k[4:] for k in keys[start + a : start + b]])
                continue
            _count(node, keys[start:stop])
            if len(node) > self.burst and length > 2:
                root[first] = parts = _Burst()
                for key, n in node.items():
                    parts.setdefault(int.from_bytes(key[:4], "big"), {})[key[4:]] = n

    def __len__(self) -> int:
        return sum(map(_size, (node for root in self.roots.values() for node in root.values())))

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take the largest subtrees out until at most ``keep`` phrases are left: (phrases, counts) of one length each."""
        size = len(self)
        by_size = sorted(((_size(node), length, first) for length, root in self.roots.items() for first, node in root.items()), reverse=True)
        gone: dict[tuple[int, int], tuple[list, list]] = defaultdict(lambda: ([], []))  # by length and depth: paths and leaves
        for n, length, first in by_size:
            if size <= keep:
                break
            node = self.roots[length].pop(first)
            size -= n
            for path, leaf in [((first, second), x) for second, x in node.items()] if isinstance(node, _Burst) else [((first,), node)]:
                paths, leaves = gone[length, len(path)]
                paths.append(path)
                leaves.append(leaf)
        for (length, depth), (paths, leaves) in gone.items():
            sizes = [len(x) for x in leaves]
            rest = np.frombuffer(b"".join(chain.from_iterable(leaves)), dtype=">u4").reshape(-1, length - depth).astype(np.int64)
            counts = np.fromiter(chain.from_iterable(x.values() for x in leaves), dtype=np.int64, count=sum(sizes))
            yield np.concatenate((np.repeat(np.array(paths, dtype=np.int64), sizes, axis=0), rest), axis=1), counts


class _Burst(dict):
    """A container's parts by the next word."""


def _size(node: dict) -> int:
    return sum(map(len, node.values())) if type(node) is _Burst else len(node)


def _count(container: dict, keys: list[bytes]) -> None:
    get = container.get
    for key in keys:
        container[key] = get(key, 0) + 1


def _packed(rest: np.ndarray) -> list[bytes]:
    return np.ascontiguousarray(rest.astype(">u4")).view(f"V{4 * rest.shape[1]}").ravel().tolist()


def _groups(column: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of the runs of equal values."""
    starts = np.flatnonzero(np.diff(column, prepend=-1) != 0)
    return zip(column[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(column)], strict=True)


class Vocabulary:
    """A task's numbers, from 1, of words that may be frequent, with their languages and hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.names, self.langs, self.hashes = [b""], [""], [0]
        self.numbers: dict[str, _Numbers] = {}

    def ids(self, lang: str, texts: list[bytes]) -> np.ndarray:
        """The words' numbers in order; 0 for other words and for breaks."""
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(lang, self)
        number = self.numbers[lang].__getitem__
        return np.concatenate([np.fromiter(map(number, part), dtype=np.int64, count=len(part)) for part in words(texts)] or [np.zeros(0, dtype=np.int64)])

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, whether it and the next one are words that may be frequent, and the pair's hash."""
        h = np.array(self.hashes, dtype=np.uint64)[ids]
        return (ids[:-1] > 0) & (ids[1:] > 0), h[:-1] ^ (h[1:] << np.uint64(21) | h[1:] >> np.uint64(43))

    def __len__(self) -> int:
        return sum(map(len, self.numbers.values()))


class _Numbers(dict):
    """One language's words."""

    def __init__(self, lang: str, of: Vocabulary):
        super().__init__({BREAK: 0})
        self.lang, self.lead, self.of, self.table, self.last = lang, lang.encode() + b"\n", of, memoryview(of.table), 64 * len(of.table) - 1

    def __missing__(self, word: bytes) -> int:
        h = xxh64_intdigest(self.lead + word, 42)
        number, at = 0, h & self.last
        if self.table[at >> 6] >> (at & 63) & 1:
            number = len(self.of.names)
            self.of.names.append(word)
            self.of.langs.append(self.lang)
            self.of.hashes.append(h)
        self[word] = number
        return number


def _set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set in ``table`` (uint64), whose size is a power of two."""
    at = h & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bit_table(phrases: DataFrame, bits: int, many: int) -> np.ndarray:
    """The bits of (lang, phrase) for phrases of ``many`` (1 or 2) words; the driver gets ``bits / 64`` numbers at most."""
    parts = F.split("phrase", " ")
    hashes = [F.xxhash64(F.concat("lang", F.lit("\n"), parts[i]).cast("binary")) for i in range(many)]
    at = hashes[0] if many == 1 else hashes[0].bitwiseXOR(F.shiftleft(hashes[1], 21).bitwiseOR(F.shiftrightunsigned(hashes[1], 43)))
    at = at.bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = phrases.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def _texts(batches) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about ``TEXT`` bytes or a thousand texts together."""
    for batch in batches:
        held, size, n = defaultdict(list), 0, 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[lang].append(t := text.as_py())
            size, n = size + len(t), n + 1
            if size >= TEXT or n >= 4096:
                yield held
                held, size, n = defaultdict(list), 0, 0
        if held:
            yield held


def _run(lang: list, head: list, tail: list, count: np.ndarray):
    """A sorted run as an Arrow batch."""
    import pyarrow as pa

    run = pa.table({"lang": pa.array(lang, pa.string()), "head": head, "tail": tail, "n": pa.array(count, pa.int64())})
    return run.sort_by([("head", "ascending"), ("tail", "ascending")]).to_batches(max_chunksize=100_000)


def _word_counts(texts: DataFrame) -> DataFrame:
    def task(batches):
        import pyarrow as pa

        counts: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, own in counts.items():
                own.pop(BREAK, None)
                if own:
                    yield from _run([lang] * len(own), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array([""] * len(own)), np.fromiter(own.values(), dtype=np.int64, count=len(own)))
            counts.clear()

        for held in _texts(batches):
            for lang, own in held.items():
                for part in words(own):
                    counts[lang].update(part)
            if sum(map(len, counts.values())) > HELD:
                yield from out()
        yield from out()

    return texts.mapInArrow(task, "lang string, head string, tail string, n long")


def _pair_counters(texts: DataFrame, word_bits, least: int, counters: int) -> np.ndarray:
    """A bit table of the pair hashes whose counter reaches ``least``; counters stop there.

    A task has ``counters`` of them and gives them away in chunks, which are added up one
    by one; the driver gets ``counters / 8`` bytes.
    """
    small, chunk = np.min_scalar_type(least), min(counters, 1 << 16)

    def task(batches):
        import pyarrow as pa

        mine, known = np.zeros(counters, dtype=small), Vocabulary(word_bits.value)
        for held in _texts(batches):
            for lang, own in held.items():
                linked, h = known.pairs(known.ids(lang, own))
                at, n = np.unique(h[linked] & np.uint64(counters - 1), return_counts=True)
                mine[at] = np.minimum(mine[at] + n, least)
            if len(known) > HELD:
                known = Vocabulary(word_bits.value)
        full = np.flatnonzero(mine.reshape(-1, chunk).any(axis=1))
        for i in full.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([zlib.compress(mine[i * chunk : (i + 1) * chunk].tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(counts.as_py()), dtype=small).astype(np.int64)
                sums[i] = np.minimum(sums.get(i, 0) + own, least)
        full = {i: np.packbits(x >= least, bitorder="little").tobytes() for i, x in sums.items() if x.max() >= least}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int64()), pa.array(list(full.values()), pa.binary())], ["chunk", "bits"])

    table = np.zeros(max(counters, 64) // 8, dtype=np.uint8)
    for row in texts.mapInArrow(task, "chunk long, counts binary").repartition("chunk").mapInArrow(add, "chunk long, bits binary").collect():
        part = np.frombuffer(row.bits, dtype=np.uint8)
        table[row.chunk * chunk // 8 :][: len(part)] = part
    return table.view(np.uint64)


def _phrase_counts(texts: DataFrame, lengths: list[int], word_bits, pair_bits) -> DataFrame:
    """Runs of the phrases of ``lengths`` words whose words and pairs all have their bits."""

    def task(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        trie, known = HatTrie(), Vocabulary(word_bits.value)

        def out(keep: int):
            vocabulary, of = pa.array(known.names, pa.binary()).cast(pa.string()), pa.array(known.langs, pa.string())
            for phrases, counts in trie.spill(keep):
                word = [pc.take(vocabulary, pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
                tail = pc.binary_join_element_wise(*word[2:], " ") if len(word) > 2 else pa.array([""] * len(counts))
                yield from _run(pc.take(of, pa.array(phrases[:, 0])), pc.binary_join_element_wise(*word[:2], " "), tail, counts)

        for held in _texts(batches):
            for lang, own in held.items():
                ids = known.ids(lang, own)
                linked, h = known.pairs(ids)
                linked &= _set(pair_bits.value, h)
                for m in lengths:
                    full = linked[: max(0, len(ids) - m + 1)].copy()
                    for i in range(1, m - 1):
                        full &= linked[i : i + len(full)]
                    at = np.flatnonzero(full)
                    if len(at):
                        trie.add(np.stack([ids[at + i] for i in range(m)], axis=1))
            if len(trie) > HELD:
                yield from out(HELD // 2)
            if len(known) > HELD:
                yield from out(0)
                known = Vocabulary(word_bits.value)
        yield from out(0)

    return texts.mapInArrow(task, "lang string, head string, tail string, n long")


def _merged(runs: DataFrame) -> DataFrame:
    """(lang, phrase, a): the runs' phrases counted together, in partitions of the prefix."""
    sums = runs.repartition("lang", "head").groupBy("lang", "head", "tail").agg(F.sum("n").alias("a"))
    return sums.select("lang", F.when(F.col("tail") == "", F.col("head")).otherwise(F.concat_ws(" ", "head", "tail")).alias("phrase"), "a")


def counted(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, a)): words by language, and the phrases of 1 to ``longest`` words that occur ``least`` times or more."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    context, often = docs.sparkSession.sparkContext, F.col("a") >= least
    all_words = stored(_merged(_word_counts(texts)))
    totals = all_words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = all_words.where(often)
    if longest > 1:
        word_bits = context.broadcast(_bit_table(found, bits, 1))
        size = 1 << min(bits.bit_length() - 1, max(16, ((totals.agg(F.sum("n")).first()[0] or 1) // 8).bit_length()))
        crowded = context.broadcast(_pair_counters(texts, word_bits, least, size))
        pairs = cut(_merged(_phrase_counts(texts, [2], word_bits, crowded)).where(often))
        found = found.unionByName(pairs)
    if longest > 2:
        pair_bits = context.broadcast(_bit_table(pairs, bits, 2))
        found = found.unionByName(cut(_merged(_phrase_counts(texts, list(range(3, longest + 1)), word_bits, pair_bits)).where(often)))
    return totals, found


def mine(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, cover: int = 100, lang_col: str = "lang", text_col: str = "text", bits: int = 1 << 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases whose parts attract each other most.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces, these
    at spaces and tabs into words. Phrases of 2 to ``longest`` words within a piece with
    ``a >= least`` occurrences are candidates. The cut after k words with the least
    ``floor(1000 a n / (l r))`` counts (l, r: occurrences of the two parts; n: all words
    of the language), the smallest k of equal ones. A candidate is dropped if it lies in
    a longer one with at least ``cover`` percent of its occurrences. Ranks go by score
    and a, both falling, then by the phrase's bytes. A null language is ``und``, a null
    text empty; repeated rows count each; ids are not read. Tables without a candidate
    give no rows.
    """
    totals, found = counted(docs, least, longest, lang_col, text_col, bits)
    parts = found.withColumn("w", F.split("phrase", " "))
    candidates = parts.where(F.size("w") > 1)
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    count = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    scored = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"]).join(totals, "lang")
    # exact: 38 digits hold 1000 a n for a below 10^15 and n below 10^19
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "l", "r")}
    scored = scored.withColumns({"_top": (F.col("a") * 1000).cast("decimal(19,0)") * whole["n"], "_under": whole["l"] * whole["r"]}).withColumn("score", F.expr("_top div _under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array(joined(F.lit(1), F.size("w") - 1), joined(F.lit(2), F.size("w") - 1))).alias("phrase"), F.col("a").alias("longer"))
    # what a longer candidate covers, the one a word longer in between covers too
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mine(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), piece AS (
  SELECT row_number() OVER () AS id, lang, p FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)
), word AS (
  SELECT id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece)
), total AS (
  SELECT lang, count(*)::HUGEINT AS n FROM word GROUP BY lang
), gram AS (
  SELECT lang, word AS w1, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3, lead(word, 3) OVER x AS w4, lead(word, 4) OVER x AS w5
  FROM word WINDOW x AS (PARTITION BY id ORDER BY i)
), f AS (
  SELECT lang, phrase, len(string_split(phrase, ' ')) AS m, count(*)::HUGEINT AS a FROM (
    SELECT lang, w1 AS phrase FROM gram
    UNION ALL SELECT lang, w1 || ' ' || w2 FROM gram WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM gram WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM gram WHERE w4 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM gram WHERE w5 IS NOT NULL) g
  GROUP BY lang, phrase HAVING count(*) >= 100
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, string_split(c.phrase, ' ') AS w FROM f c, generate_series(1, 4) s(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
  FROM cut c JOIN total t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM scored) s WHERE rn = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = b.lang AND x.m > len(string_split(b.phrase, ' ')) AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.a >= 100 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
