"""Operator 11: benchmark decontamination with an FM-index per training shard.

A shard is a stretch of the documents of one task. Its words are numbered by the
vocabulary of the benchmark's windows; any other word, and the end of a document, is a
separator, since no window can reach over it, and neighbouring separators are one. The
shard's suffixes are sorted, the column before them (the BWT) goes into a wavelet
matrix, and every window is searched backwards, all windows at once, by ranks in that
matrix. Rows of the intervals found are walked back to the next sampled suffix to learn
where they stand. Words inside an occurrence are hit; hits of a document are merged into
spans.

Texts are neither shuffled nor stored. The windows are broadcast in blocks of at most
``block`` bytes of item texts; one pass serves one block, so a benchmark of any size can
be searched. Consecutive shards share ``width - 1`` symbols, so a text may be longer
than a shard.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, resident, stored

SHARD = 1 << 20  # symbols of one index
TEXT = 4 << 20  # bytes of texts whose words are looked up together
BLOCK = 32 << 20
#: A-Z become lower case; all that is neither 0-9 nor a-z nor beyond ASCII becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
END = b"."  # no word is this


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix ends at the next 0, equal ones stand by position.

    Several symbols are packed into the first key, with the position below them, so that
    plain sorting gives the order; then what is compared doubles, for groups still open.
    At most 2**21 symbols, of which the last is 0.
    """
    n = len(symbols)
    place, bits = max(1, (n - 1).bit_length()), max(1, int(symbols.max(initial=0)).bit_length())
    mask, depth = (1 << place) - 1, min(n, max(1, (63 - place) // bits))
    key = np.zeros(n, dtype=np.int64)
    goes_on = np.ones(n, dtype=bool)
    for j in range(depth):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - j] = symbols[j:]
        ahead *= goes_on
        key = key << bits | ahead
        goes_on = ahead > 0
    packed = np.sort(key << place | np.arange(n))
    order, at = packed & mask, np.arange(n)
    packed >>= place
    group = np.maximum.accumulate(np.where(np.diff(packed, prepend=-1) != 0, at, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    while True:
        alike = np.zeros(n + 1, dtype=bool)
        alike[1:n] = group[1:] == group[:-1]
        open_ = np.flatnonzero((alike[1:] | alike[:-1]) & goes_on[order])
        if not len(open_):
            return order
        starts = order[open_]
        packed = np.sort(group[open_] << 2 * place | rank[starts + depth] << place | starts)
        order[open_] = packed & mask
        packed >>= place
        group[open_] = np.maximum.accumulate(np.where(np.diff(packed, prepend=-1) != 0, open_, 0))
        rank[order[open_]] = group[open_]
        goes_on[: n - depth] &= goes_on[depth:]
        depth *= 2


class Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 2, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FmIndex:
    """Backward search and location in ``symbols``: numbers from 1, separated by 0, which is also the last.

    Every ``step``-th suffix and every first one after a separator has its position kept;
    walks to the left never have to cross a separator.
    """

    def __init__(self, symbols: np.ndarray, step: int = 16):
        order = suffix_order(symbols)
        column = symbols[order - 1]  # before the first symbol stands the last, a 0
        marked = (order % step == 0) | (column == 0)
        self.marks, self.places = Bits(marked), order[marked]
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))))
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            high = (column >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(high), len(high) - int(high.sum())))
            column = np.concatenate((column[~high], column[high]))
        self.base = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            ones = level.ones(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` rows have ``symbol`` before them."""
        return self._down(symbol, i) - self.base[symbol]

    def left(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer to the left."""
        symbol, i = np.zeros(len(row), dtype=np.int64), row
        for _, level, zeros in self.levels:
            high, ones = level[i], level.ones(i)
            i = np.where(high, zeros + ones, i - ones)
            symbol = symbol << 1 | high
        return self.first[symbol] + i - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row intervals of ``phrases``, one a row of the matrix, ``lengths`` symbols and then zeros."""
        inside = (phrases < 1 << self.bits).all(axis=1)
        live = np.flatnonzero(inside)
        last = phrases[live, lengths[live] - 1]
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        lo[live], hi[live] = self.first[last], self.first[last + 1]
        for t in range(1, phrases.shape[1]):
            live = live[lo[live] < hi[live]]
            more = live[lengths[live] > t]
            symbol = phrases[more, lengths[more] - 1 - t]
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((lo[more], hi[more])))
            lo[more], hi[more] = self.first[symbol] + both[: len(more)], self.first[symbol] + both[len(more) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, open_, walked = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(open_):
            known = self.marks[rows]
            out[open_[known]] = self.places[self.marks.ones(rows[known])] + walked
            open_, rows, walked = open_[~known], self.left(rows[~known]), walked + 1
        return out


class Windows:
    """The distinct windows of items (id as text, text as bytes), their vocabulary and the items that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {END: -1}
        owners: dict[tuple, set[int]] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.translate(PLAIN).split()]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + width]), set()).update([number[name]] if name is not None else [])
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.phrases = np.zeros((len(owners), width), dtype=np.int64)
        for row, w in zip(self.phrases, owners, strict=True):
            row[: len(w)] = w
        self.many = np.array([len(x) for x in owners.values()], dtype=np.int64)
        self.owner = np.array([i for x in owners.values() for i in sorted(x)], dtype=np.int64)

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """The words' numbers, 0 for other words, -1 for the end of each text."""
        joined, out, at = b" ".join(x for t in texts for x in (t.translate(PLAIN), END)), [], 0
        while at < len(joined):
            to = joined.find(b" ", at + TEXT)
            words = joined[at : to if to >= 0 else len(joined)].split()
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words)))
            at = to if to >= 0 else len(joined)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def occurrences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in ``numbers``) of every occurrence; separators are 0 or less."""
        known = numbers > 0
        at = np.flatnonzero(known | np.concatenate(([False], known[:-1])))
        found = [np.zeros((2, 0), dtype=np.int64)]
        overlap = self.phrases.shape[1] - 1
        for start in range(0, len(at) if len(self.lengths) else 0, SHARD - overlap):
            part = at[start : start + SHARD]
            index = FmIndex(np.append(np.maximum(numbers[part], 0), 0))
            lo, hi = index.search(self.phrases, self.lengths)
            times = hi - lo
            rows = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            found.append(np.stack((np.repeat(np.arange(len(lo)), times), part[index.locate(rows)])))
        return tuple(np.concatenate(found, axis=1))


def _pairs(a: np.ndarray, b: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order; ``b`` is less than ``of``."""
    both = np.unique(a * max(of, 1) + b)
    return both // max(of, 1), both % max(of, 1)


def _found(texts: list[bytes], earlier: list, windows: Windows) -> list[tuple]:
    """For each text (words, hit, items, spans of words, spans of code points), with the spans of words ``earlier`` found."""
    numbers = windows.numbers(texts)
    ends = np.flatnonzero(numbers < 0)
    begins = np.concatenate(([0], ends[:-1] + 1))
    window, place = windows.occurrences(numbers)
    before = np.array([(begins[i] + s["start"], begins[i] + s["end"]) for i, spans in enumerate(earlier) for s in spans], dtype=np.int64).reshape(-1, 2)
    size = len(numbers) + 1
    change = np.bincount(np.append(place, before[:, 0]), minlength=size) - np.bincount(np.append(place + windows.lengths[window], before[:, 1]), minlength=size)
    hit = np.concatenate(([False], np.cumsum(change) > 0))
    starts, stops = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
    doc = np.searchsorted(ends, starts)
    spans: dict[int, list] = {}
    for d, s, e in zip(doc.tolist(), (starts - begins[doc]).tolist(), (stops - begins[doc]).tolist(), strict=True):
        spans.setdefault(d, []).append((s, e))
    d, w = _pairs(np.searchsorted(ends, place), window, len(windows.lengths))
    times = windows.many[w]
    from_ = np.repeat(np.cumsum(windows.many)[w] - windows.many[w] - np.cumsum(times) + times, times) + np.arange(times.sum())
    items: dict[int, list[str]] = {}
    for i, o in zip(*(x.tolist() for x in _pairs(np.repeat(d, times), windows.owner[from_], len(windows.names))), strict=True):
        items.setdefault(i, []).append(windows.names[o])
    out = []
    for i, n in enumerate((ends - begins).tolist()):
        own = spans.get(i, [])
        at = [m.span() for m in WORD.finditer(texts[i].decode("utf-8", "replace"))] if own else []
        out.append((n, sum(e - s for s, e in own), items.get(i, []), [{"start": s, "end": e} for s, e in own], [{"start": at[s][0], "end": at[e - 1][1]} for s, e in own]))
    return out


def _pass(state: DataFrame, items: list[tuple[str | None, bytes]], width: int) -> DataFrame:
    """One block's hits added to ``state`` (id, text as binary, words, items)."""
    shared, id_type = state.sparkSession.sparkContext.broadcast(items), state.schema["id"].dataType.simpleString()
    key = ("windows", uuid.uuid4().hex)

    def task(batches):
        import pyarrow as pa

        windows = resident(key, lambda: Windows(shared.value, width))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def result(batch, at, to, texts):
            got = _found(texts, batch.column(2)[at:to].to_pylist(), windows)
            n, hit, names, words, spans = zip(*got, strict=True)
            names = [sorted({*x, *y}) for x, y in zip(names, batch.column(3)[at:to].to_pylist(), strict=True)]
            columns = [batch.column(0)[at:to], batch.column(1)[at:to], pa.array(words, span), pa.array(names, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, span)]
            return pa.RecordBatch.from_arrays(columns, ["id", "text", "words", "items", "n_words", "n_hit", "spans"])

        for batch in batches:
            at, texts, held = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1])
                if held >= TEXT or i == batch.num_rows - 1:
                    yield result(batch, at, i + 1, texts)
                    at, texts, held = i + 1, [], 0

    spans = "array<struct<start: long, end: long>>"
    return state.mapInArrow(task, f"id {id_type}, text binary, words {spans}, items array<string>, n_words long, n_hit long, spans {spans}")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block: int = BLOCK) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for every row of ``docs``: where ``items`` occur in it.

    Words are what lies between ASCII signs other than digits and letters, A-Z in lower
    case. A window is ``width`` consecutive words of an item, or all words of a shorter
    one. ``items``: ids as text of items with an occurring window, sorted; ``spans``:
    code points [start, end) of the merged occurrences. Null texts have no words; an item
    without words is never found; an item with a null id marks words but is not listed;
    repeated items count once. Repeated rows and null ids of ``docs`` stay, a result
    each. An empty table of items gives no hits. Only the named columns are read.
    """
    names = items.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    names = cut(names.withColumn("size", F.length("text") + F.coalesce(F.length("id"), F.lit(0)) + 64))
    blocks = max(1, -(-(names.agg(F.sum("size")).first()[0] or 0) // block))
    none = F.array().cast("array<struct<start: long, end: long>>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    state = docs.select(F.col(id_col).alias("id"), text.alias("text"), none.alias("words"), F.array().cast("array<string>").alias("items"))
    for i in range(blocks):
        mine = names.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).select("id", "text").collect()  # about `block` bytes
        done = _pass(state.select("id", "text", "words", "items"), [(r.id, bytes(r.text)) for r in mine], width)
        if i < blocks - 1:
            done, last = stored(done), state if i else None
            if last is not None:
                discard(last)
        state = done
    return state.select("id", "n_words", "n_hit", "items", "spans")


def without(text: Column, spans: Column) -> Column:
    """``text`` less its ``spans`` of code points, which are in order and apart."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))

    def keep(state: Column, span: Column) -> Column:
        return F.struct(span["end"].alias("at"), F.concat(state["kept"], text.substr((state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))).alias("kept"))

    rest = lambda state: F.concat(state["kept"], text.substr((state["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, start, keep, rest)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), cut AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM cut
), sizes AS (
  SELECT DISTINCT size FROM win
), dw AS (
  SELECT k, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT k, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d JOIN sizes ON len(w) >= size) x
), hit AS (
  SELECT k, i, dw.size, item_id FROM dw JOIN win ON win.size = dw.size AND win.s = dw.s
), spot AS (
  SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + size - 1)) AS pos FROM hit) x GROUP BY k
), listed AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) x GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot USING (k) LEFT JOIN listed USING (k)
"""
