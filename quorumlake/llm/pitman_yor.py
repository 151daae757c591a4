"""Operator 5: language-model scoring by a hierarchical Pitman-Yor model.

Words are dishes of context restaurants. A word's context is the whole word before it, or
the start of the text; such a restaurant's parent is that of its word's ending (the last
byte), 256 at most. These all share one parent, the restaurant of words without context,
whose parent is a spelling model:
restaurants whose dishes are symbols (frequent code points, the end of a word, one for
all other code points) and whose contexts are the last 3, 2, 1 and 0 symbols of the word,
each context's parent being the one without its oldest symbol. As in the base score, all
words that training has not seen are one outcome, with the probability that spelling
leaves to them, one less that of all known words.

Seating is sampled by Gibbs. A sweep seats all customers of a dish together: the number of
its tables is drawn from its distribution given all other dishes, in which the tables'
sizes, which predictions don't need, are summed out. Each table sends a customer to the
parent. A pair of words with one customer has one table; the others are drawn side by
side, and the endings' customers are counted anew from their tables. Of the endings and
the root a word's restaurants are sampled together, words side by side, given the
restaurants' totals after the sweep before. In the spelling model single customers move:
one that is drawn at random leaves its table, and is seated again at a table with
probability in proportion to its size less the discount, or at a new one in proportion to
the parent's probability; ``moves`` of every dish in a sweep. Random numbers come from the dish and the step, so results do
not depend on partitions, batches or lost executors. Predictive probabilities are
averaged over two seatings: a whole word's restaurant's own part and share for its parent,
and the parent's probabilities, each over both, so that they sum to one.

The spelling model is bounded by ``SYMBOLS ** ORDER`` at any corpus size; the words'
counts come from all training texts and stay distributed. Texts are packed in batches of
bounded size, words in buckets by hash, and a bucket holds its words' seatings in the
endings' restaurants and all pairs that end in them, so that a sweep shuffles only the
tables of each context's restaurant. Batches and buckets send each other packed, compressed
columns: each of a batch's distinct words and pairs goes once to its bucket, to be counted,
and its answer comes back in the same order, so neither vocabulary nor texts pass through
one task or the driver. A word has at most as many pairs as there are words, in one bucket.
Random numbers know words by ``word_id``: among 10^8 words two share one with a probability
of about half a percent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import lgamma
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, release, residue, slim, stored, tidy

SYMBOLS, ORDER = 64, 4
END, SPACE, OTHER = 0, 1, 63
CODE_POINTS = 0x110000
DISCOUNTS, STRENGTH = (0.5, 0.6, 0.7, 0.8), 1.0
END_TOKEN = b" "  # no word is or holds a space; its ending is the context of a text's first word
CONTEXTS = 256
EXACT, WIDE = 4096, 1024  # customers and tables of the table of seatings' weights
Q = 4000  # probabilities in contexts are kept to 1 / Q of log10


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # on bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only


def spelled(w: list[bytes], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol n-grams of words as numbers (context digits, then the symbol), where each word starts, and how many other code points it has.

    A word is its symbols and SPACE, from a context of ENDs; END_TOKEN is the symbol END alone.
    """
    text = b" ".join(b"\n" if x == END_TOKEN else x for x in w) + b" "
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sym = np.concatenate([np.full(ORDER - 1, SPACE, dtype=np.int32), lut[points].astype(np.int32)])
    c1, c2, c3, now = sym[2:-1].copy(), sym[1:-2].copy(), sym[:-3].copy(), sym[3:]
    c1[c1 == SPACE] = END
    c2[(c2 == SPACE) | (c1 == END)] = END
    c3[(c3 == SPACE) | (c2 == END)] = END
    codes = ((c3 * SYMBOLS + c2) * SYMBOLS + c1) * SYMBOLS + now
    real = ~((now == SPACE) & (c1 == END))  # the separator behind an END_TOKEN is no symbol
    starts = np.flatnonzero(np.concatenate([[True], now[:-1] == SPACE]))
    return np.where(real, codes, -1), starts, np.add.reduceat((now == OTHER).astype(np.int64), starts)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for every key (uint64) and the step, by the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def first_tables(key: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, grow: float = 0.05) -> np.ndarray:
    """An estimate of each dish's tables to start from: the expected number as customers come in, rounded at random.

    ``others``: the tables of the restaurant's other dishes.
    """
    order = np.argsort(-customers, kind="stable")
    c, o, p = customers[order], others[order].astype(np.float64), parent[order]
    t = np.minimum(c, 1).astype(np.float64)
    i = 1
    while (live := int(np.searchsorted(-c, -i, side="left"))) > 0:
        step = max(1, int(i * grow))
        new = (STRENGTH + discount * (o[:live] + t[:live])) * p[:live]
        t[:live] += np.minimum(step, c[:live] - i) * new / (new + i - discount * t[:live])
        i += step
    out = np.empty(len(c), dtype=np.int64)
    out[order] = np.floor(t + uniform(key[order], 0)).astype(np.int64)
    return np.clip(out, np.minimum(customers, 1), customers)


@lru_cache(maxsize=4)
def log_seatings(discount: float) -> np.ndarray:
    """[c, t - 1], c up to ``EXACT`` and t up to ``WIDE``: the logarithm of the summed weights of all ways to seat c customers at t tables, new tables counted 1, less that of the likeliest t."""
    out = np.full((EXACT + 1, WIDE), -np.inf, dtype=np.float32)
    row = np.full(WIDE, -np.inf)
    row[0] = 0.0
    t = np.arange(1, WIDE + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT + 1):
            out[c] = row - row.max()
            row = np.logaddexp(np.concatenate(([-np.inf], row[:-1])), np.log(np.maximum(0.0, c - discount * t)) + row)
            row -= row.max()
    return out


@lru_cache(maxsize=50_000)
def _log_seatings_of_many(c: int, discount: float, wide: int) -> np.ndarray | None:
    """As a row of ``log_seatings``, for any c, by the alternating sum over j <= t of C(t, j) Gamma(c - j d) / Gamma(-j d); None if it cancels out."""
    j = np.arange(1, wide + 1)
    size = np.array([-np.inf if float(x * discount).is_integer() else lgamma(c - discount * x) - lgamma(-discount * x) for x in j.tolist()])
    sign = np.where((np.ceil(discount * j) + j) % 2 == 0, 1.0, -1.0)  # of (-1)^j / Gamma(-j d)
    factorial = np.concatenate(([0.0], np.cumsum(np.log(j))))
    terms = np.where(j[None] <= j[:, None], factorial[j][:, None] - factorial[j][None] - factorial[np.maximum(0, j[:, None] - j[None])] + size[None], -np.inf)
    most = terms.max(axis=1, keepdims=True)
    total = (sign * np.exp(terms - most)).sum(axis=1)
    if not (total > 1e-6).all():
        return None
    row = np.log(total) + most[:, 0] - j * np.log(discount) - factorial[j]
    return (row - row.max()).astype(np.float32)


def drawn_tables(key: np.ndarray, c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, step: int) -> np.ndarray:
    """A draw of each dish's number of tables given all others: its customers are seated together, the sizes summed out.

    ``others`` are the tables of the restaurant's other dishes. The weights of t tables
    come from a table, or for more customers from a sum that is exact while t is small
    against c to the power of the discount. A dish whose likely t lie beyond gets the
    number that its customers, one after another, would be expected to open.
    """
    t, u, known = np.minimum(c, 1), uniform(key, step), log_seatings(discount)
    order = np.argsort(c, kind="stable")
    counts, starts = np.unique(c[order], return_index=True)
    left = []
    for n, start, stop in zip(counts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
        if n < 2:
            continue
        open_ = order[start:stop]
        for wide in dict.fromkeys(min(n, most) for most in (16, 64, 256, WIDE)):
            row = known[n, :wide] if n <= EXACT else _log_seatings_of_many(n, discount, wide)
            if row is None or not len(open_):
                break
            far = [open_[:0]]
            for i in range(0, len(open_), max(1, 1_000_000 // wide)):
                at = open_[i : i + max(1, 1_000_000 // wide)]
                weight = np.log((STRENGTH + discount * (others[at, None] + np.arange(wide))) * np.maximum(parent[at, None], 1e-300))
                np.cumsum(weight, axis=1, out=weight)
                weight += row
                weight -= weight.max(axis=1, keepdims=True)
                beyond = (weight[:, -1] > -25) & (wide < n)  # what is cut off may count
                np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
                t[at] = 1 + (weight < u[at, None] * weight[:, -1:]).sum(axis=1)
                far.append(at[beyond])
            open_ = np.concatenate(far)
        left.append(open_)
    if len(rest := np.concatenate([order[:0], *left])):
        t[rest] = first_tables(key[rest], c[rest], others[rest], parent[rest], discount)
    return np.minimum(t, c)


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range of ``n``."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Seating:
    """Tables of many dishes, each dish's side by side with room for ``spare`` more.

    ``c`` are the customers and ``t`` the tables of every dish, ``sizes`` all tables in the order of the dishes.
    """

    def __init__(self, key: np.ndarray, c: np.ndarray, t: np.ndarray, sizes: np.ndarray, spare: np.ndarray, discount: float, step: int = 1):
        self.key, self.c, self.t, self.discount, self.step = key, c.copy(), t.copy(), discount, step
        room = t + spare
        self.start = np.cumsum(room) - room
        self.size = np.zeros(int(room.sum()), dtype=np.int64)
        self.size[_ragged(self.start, t)] = sizes

    @staticmethod
    def spread(key: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Sizes of the tables to start from: every table one customer, the others dealt out unevenly."""
        rank = _ragged(np.zeros(len(t), dtype=np.int64), t)
        owner = np.repeat(np.arange(len(t)), t)
        with np.errstate(over="ignore"):
            share = -np.log(1.0 - uniform(key[owner] ^ (rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 2)) + 1e-9
        share /= np.bincount(owner, share, len(t))[owner]
        sizes = 1 + np.floor((c - t)[owner] * share).astype(np.int64)
        left = c - np.bincount(owner, sizes, len(t)).astype(np.int64)
        some = t > 0
        sizes[(np.cumsum(t) - t)[some]] += left[some]
        return sizes

    def sizes(self) -> np.ndarray:
        return self.size[_ragged(self.start, self.t)]

    def _draw(self) -> int:
        self.step += 1
        return self.step

    def _table(self, at: np.ndarray, minus: float) -> np.ndarray:
        """A table of each dish in ``at``, in proportion to its size less ``minus``."""
        n = self.t[at]
        flat = _ragged(self.start[at], n)
        ends = np.cumsum(self.size[flat] - minus)
        last = np.cumsum(n) - 1
        before = ends[last] - np.add.reduceat(self.size[flat] - minus, last - n + 1)
        pick = np.searchsorted(ends, before + uniform(self.key[at], self._draw()) * (ends[last] - before), side="right")
        return flat[np.clip(pick, last - n + 1, last)]

    def remove(self, at: np.ndarray) -> None:
        """One customer of each dish in ``at`` leaves, drawn at random."""
        if len(at):
            table = self._table(at, 0)
            self.size[table] -= 1
            self.c[at] -= 1
            empty = self.size[table] == 0
            gone, end = table[empty], (self.start + self.t - 1)[at[empty]]
            self.size[gone] = self.size[end]
            self.size[end] = 0
            self.t[at[empty]] -= 1

    def add(self, at: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """One customer of each dish in ``at`` comes in; ``weight`` (dishes, their tables) is that of a new table."""
        if len(at):
            new = weight(at, self.t[at])
            opens = (self.t[at] == 0) | (uniform(self.key[at], self._draw()) * (new + self.c[at] - self.discount * self.t[at]) < new)
            joins = at[~opens]
            if len(joins):
                self.size[self._table(joins, self.discount)] += 1
            at_new = at[opens]
            self.size[self.start[at_new] + self.t[at_new]] = 1
            self.t[at_new] += 1
            self.c[at] += 1

    def sweep(self, moves: int, weight) -> None:
        """Up to ``moves`` customers of every dish leave and are seated again, one after another."""
        for j in range(moves):
            at = np.flatnonzero(self.c > max(1, j))  # a customer alone has nowhere else to sit
            self.remove(at)
            self.add(at, weight)

    def become(self, c: np.ndarray, weight) -> None:
        """Customers leave or come in until there are ``c``, as tables of children close and open."""
        while len(at := np.flatnonzero(self.c > c)):
            self.remove(at)
        while len(at := np.flatnonzero(self.c < c)):
            self.add(at, weight)


def _predict(c: np.ndarray, t: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """Predictive probabilities of dishes (last axis) in restaurants (other axes)."""
    return (c - discount * t + (STRENGTH + discount * t.sum(-1, keepdims=True)) * parent) / (STRENGTH + c.sum(-1, keepdims=True))


class Level:
    """The restaurants of one depth, dense over [restaurant, dish], with a seating of the dishes that have customers or may get some."""

    def __init__(self, seed: int, c: np.ndarray, room: np.ndarray, parent: np.ndarray, discount: float):
        self.c, self.discount = c, discount
        self.cells = np.flatnonzero(room.ravel())
        key = (self.cells.astype(np.uint64) << np.uint64(20)) ^ np.uint64(seed)
        n, wide = c.ravel()[self.cells], np.broadcast_to(parent, c.shape)
        others = np.broadcast_to(np.minimum(c, 1).sum(-1, keepdims=True), c.shape).ravel()[self.cells] - np.minimum(n, 1)
        t = first_tables(key, n, others, wide.ravel()[self.cells], discount)
        self.seats = Seating(key, n, t, Seating.spread(key, n, t), room.ravel()[self.cells] - t, discount)

    def tables(self) -> np.ndarray:
        out = np.zeros(self.c.size, dtype=np.int64)
        out[self.cells] = self.seats.t
        return out.reshape(self.c.shape)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        return _predict(self.c, self.tables(), parent, self.discount)

    def _weight(self, parent: np.ndarray):
        total = self.tables().sum(-1, keepdims=True)
        others = np.broadcast_to(total, self.c.shape).ravel()[self.cells] - self.seats.t
        p = np.broadcast_to(parent, self.c.shape).ravel()[self.cells]
        return lambda at, t: (STRENGTH + self.discount * (others[at] + t)) * p[at]

    def sweep(self, c: np.ndarray, parent: np.ndarray, moves: int) -> None:
        weight = self._weight(parent)
        self.c = c
        self.seats.become(c.ravel()[self.cells], weight)
        self.seats.sweep(moves, weight)


def sample(group: int, codes: np.ndarray, n: np.ndarray, root: np.ndarray, burn: int, samples: int, seed: int, moves: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seatings of the restaurants whose contexts end in ``group``: (tables sent to the root, mean predictives of [a, b, symbol] and of [b, symbol])."""
    s = SYMBOLS
    c3 = np.zeros((s, s, s), dtype=np.int64)
    c3[codes // s**3, codes // s**2 % s, codes % s] = n
    seed = (seed * 1009 + group) << 40
    room3 = c3.sum(0) if c3.size else c3
    three = Level(seed, c3, c3, np.full(s, 1 / s), DISCOUNTS[3])
    two = Level(seed + 1, three.tables().sum(0), room3, np.full(s, 1 / s), DISCOUNTS[2])
    one = Level(seed + 2, two.tables().sum(0), room3.sum(0), root, DISCOUNTS[1])
    mean, mean2 = np.zeros((s, s, s)), np.zeros((s, s))
    for sweep in range(burn + samples):
        p1 = one.predict(root)
        p2 = two.predict(p1)
        three.sweep(c3, p2, moves)
        two.sweep(three.tables().sum(0), p1, moves)
        one.sweep(two.tables().sum(0), root, moves)
        if sweep >= burn:
            p2 = two.predict(one.predict(root))
            mean2 += p2
            mean += three.predict(p2)
    return one.tables(), mean / max(1, samples), mean2 / max(1, samples)


def word_id(word: bytes) -> int:
    """A word's XXH64 with its last byte in place of the lowest: a context's number tells its ending."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(word, 42) & ~255 | word[-1]
    return x - (1 << 64) if x >> 63 else x


def endings(w: list[bytes]) -> np.ndarray:
    """The context that each word is for the next."""
    return np.frombuffer(bytes([x[-1] for x in w]), dtype=np.uint8)


def symbols(words_: DataFrame) -> np.ndarray:
    """The symbol of every code point: those in the most words have one of their own."""

    def task(batches):
        import pyarrow as pa

        total = np.zeros(CODE_POINTS, dtype=np.int64)
        for batch in batches:
            points = np.frombuffer(b"".join(batch.column(0).to_pylist()).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            if len(points):
                seen = np.bincount(points)
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["point", "n"])

    counts = words_.select("word").mapInArrow(task, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    lut = np.full(CODE_POINTS, OTHER, dtype=np.uint8)
    lut[32], lut[10] = SPACE, END  # neither is in a word
    for i, r in enumerate(counts.where("point <> 32").orderBy(F.desc("n"), "point").limit(OTHER - 2).collect()):
        lut[r.point] = i + 2
    return lut


class Spelling(NamedTuple):
    lut: np.ndarray  # symbol of every code point
    place: np.ndarray  # row of every context
    rows: np.ndarray  # log10 of the averaged predictive probability of each symbol


def spelling(tables: DataFrame, lut: np.ndarray, burn: int = 2, samples: int = 2, seed: int = 11) -> Spelling:
    """The spelling model of the customers ``tables``: (word, t)."""
    spark = tables.sparkSession
    shared = spark.sparkContext.broadcast(lut)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                codes, starts, _ = spelled(batch.column(0).to_pylist(), shared.value)
                weight = np.repeat(batch.column(1).to_numpy(), np.diff([*starts, len(codes)]))
                np.add.at(total, codes[codes >= 0], weight[codes >= 0])
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    counts = tables.select("word", "t").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("g", F.expr(f"int(code div {SYMBOLS}) % {SYMBOLS}")))
    flat = np.full(SYMBOLS, 1 / SYMBOLS)

    def first(key, rows):
        import pandas as pd

        sent, _, _ = sample(int(key[0]), rows["code"].to_numpy(), rows["n"].to_numpy(), flat, burn, 1, seed)
        return pd.DataFrame({"w": np.arange(SYMBOLS, dtype=np.int32), "t": sent})

    root = np.zeros(SYMBOLS, dtype=np.int64)
    for r in counts.groupBy("g").applyInPandas(first, "w int, t long").groupBy("w").agg(F.sum("t").alias("t")).collect():
        root[r.w] = r.t
    top, mean0 = Level(seed, root, root, flat, DISCOUNTS[0]), np.zeros(SYMBOLS)
    for sweep in range(burn + samples):
        top.sweep(root, flat, 16)
        if sweep >= burn:
            mean0 += top.predict(flat) / samples

    def second(key, rows):
        import pandas as pd

        codes = rows["code"].to_numpy()
        _, mean, short = sample(int(key[0]), codes, rows["n"].to_numpy(), mean0, burn, samples, seed + 1)
        seen = np.unique(codes // SYMBOLS)
        deep = mean[seen // SYMBOLS**2, seen // SYMBOLS % SYMBOLS]
        return pd.DataFrame({"g": [int(key[0])], "seen": [seen.astype("<i4").tobytes()], "deep": [np.log10(deep).astype("<f4").tobytes()], "short": [np.log10(short).astype("<f4").tobytes()]})

    # a context that was never seen has its parent's probabilities: the two last symbols', or the root's
    rows, at = [np.log10(mean0).astype(np.float32)[None]], 1
    place = np.zeros(SYMBOLS ** (ORDER - 1), dtype=np.int32)
    context = np.arange(len(place))
    for r in cut(counts.groupBy("g").applyInPandas(second, "g int, seen binary, deep binary, short binary")).toLocalIterator():  # SYMBOLS rows of 1 MB at most
        seen, ends = np.frombuffer(r.seen, dtype="<i4"), context % SYMBOLS == r.g
        place[ends] = at + context[ends] // SYMBOLS % SYMBOLS
        place[seen] = at + SYMBOLS + np.arange(len(seen))
        rows += [np.frombuffer(x, dtype="<f4").reshape(-1, SYMBOLS) for x in (r.short, r.deep)]
        at += SYMBOLS + len(seen)
    return Spelling(lut, place, np.concatenate(rows))


def log10_spelling(w: list[bytes], model: Spelling) -> np.ndarray:
    """log10 of the spelling model's probability of each word."""
    if not w:
        return np.zeros(0)
    codes, starts, others = spelled(w, model.lut)
    p = np.where(codes >= 0, model.rows[model.place[codes // SYMBOLS], codes % SYMBOLS], 0).astype(np.float64)
    return np.add.reduceat(p, starts) - others * float(np.log10(CODE_POINTS))


class Totals(NamedTuple):
    """What all words together have in the restaurants: tables of every context, and customers and tables of the root."""

    tables: np.ndarray
    customers: int
    root: int
    guests: np.ndarray  # customers of every context


def _packed(values: np.ndarray, n: np.ndarray, kind: str):
    """A column of packed numbers, ``n`` of them in each row."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) * np.dtype(kind).itemsize
    if offsets[-1] >= 1 << 31:
        raise OverflowError(f"{offsets[-1]} bytes of packed numbers in one slice; Arrow's offsets end at 2 GB")
    offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(kind).tobytes())])


#: Packed rows that go from one batch of texts or bucket of words to another: ``to`` and ``sender`` are their numbers.
PACKED = "to long, kind string, sender long, parts array<binary>"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, of the width that the largest needs."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    kind = x.dtype.kind == "f"
    width = x.dtype.itemsize if kind else 8 if not len(x) or x.min() < 0 else next(i for i in (1, 2, 3, 4, 8) if i == 8 or int(x.max()) >> 8 * i == 0)
    raw = (x if kind else x.astype("<i8")).view(np.uint8).reshape(len(x), x.dtype.itemsize if kind else 8)[:, :width]
    return bytes([kind, width]) + len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(raw.T), codec="zstd", asbytes=True)


def opened(blob: bytes) -> np.ndarray:
    """What ``squeezed`` took: whole numbers as int64."""
    import pyarrow as pa

    kind, width, n = blob[0], blob[1], int.from_bytes(blob[2:10], "little")
    planes = np.frombuffer(pa.decompress(blob[10:], decompressed_size=n * width, codec="zstd") if n else b"", dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, width if kind else 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.ravel().view(f"<f{width}" if kind else "<i8")


def _rising(x: np.ndarray) -> bytes:
    return squeezed(np.diff(x, prepend=0))


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(opened(blob))


def _joined(w: list[bytes]) -> bytes:
    import pyarrow as pa

    text = b"\n".join(w)  # no word holds a line's end, and none is empty
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _parted(blob: bytes) -> list[bytes]:
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True).split(b"\n") if n else []


def _table(rows: list[tuple]):
    import pyarrow as pa

    to, kind, sender, parts = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"to": pa.array(to, pa.int64()), "kind": pa.array(kind, pa.string()), "sender": pa.array(sender, pa.int64()), "parts": pa.array(parts, pa.list_(pa.binary()))})


def _grouped(rows: DataFrame, task: Callable, schema: str = PACKED) -> DataFrame:
    """``task`` (number, {kind: [(sender, parts)], by sender}) for all packed rows that go to one batch or bucket; it returns rows, or a table of another ``schema``."""

    def run(key, group):
        release()
        held: dict[str, list] = {}
        for kind, sender, parts in sorted(zip(*(group.column(x).to_pylist() for x in ("kind", "sender", "parts")), strict=True), key=lambda r: r[:2]):
            held.setdefault(kind, []).append((sender, parts))
        out = task(key[0].as_py(), held)
        return _table(out) if schema == PACKED else out

    return rows.groupBy("to").applyInArrow(run, schema)


def _each(rows: DataFrame, task: Callable, schema: str = PACKED) -> DataFrame:
    """``task`` (number, parts) for every packed row by itself; it returns rows, or a table of another ``schema``."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                release()
                out = task(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                yield from (_table(out) if schema == PACKED else out).to_batches(max_chunksize=50_000)

    return rows.select("to", "parts").mapInArrow(run, schema)


def _numbered(texts) -> tuple[list[bytes], list[np.ndarray]]:
    """The sorted words of ``texts``, END_TOKEN among them, and each text's numbers of them, an end before and behind: alike in any order of the texts."""
    names: dict[bytes, int] = {END_TOKEN: 0}
    tokens = []
    for t in texts:
        w = words(t.as_py())
        got = np.zeros(len(w) + 2, dtype=np.int64)
        got[1:-1] = [names.setdefault(x, len(names)) for x in w]
        tokens.append(got)
    listed = list(names)
    order = sorted(range(len(listed)), key=listed.__getitem__)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return [listed[i] for i in order], [rank[x] for x in tokens]


def _pair_codes(tokens: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs of ``_numbered`` texts, sorted: the word, and the one before it in the lower 32 bits."""
    return np.unique(np.concatenate([x[1:] << 32 | x[:-1] for x in tokens]))


def batched(rows: DataFrame, batch_bytes: int) -> DataFrame:
    """Packed batches of ``rows`` (doc_id, held_out, text), as they lie in their files: numbers of words in place of texts, and each word's occurrences in rows not held out.

    A batch ends with the text that brings it to ``batch_bytes``.
    """

    def packed(ids, held, texts, number):
        names, tokens = _numbered(texts)
        length = np.array([len(x) - 1 for x in tokens])
        stream = np.concatenate([x[1:] for x in tokens])
        times = np.bincount(stream, minlength=len(names))
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        stream = rank[stream]
        learned = np.bincount(stream[~np.repeat(held, length)], minlength=len(names))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        parts = [squeezed(ids.fill_null(0).to_numpy(zero_copy_only=False)), squeezed(known.astype(np.int64)), squeezed(held.astype(np.int64)), squeezed(length), squeezed(stream), _joined([names[i] for i in order]), squeezed(learned)]
        return _table([(number, "batch", 0, parts)]).to_batches()

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        release()
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def out():
            b = pa.Table.from_batches(waiting).combine_chunks()
            return packed(b.column(0).combine_chunks(), b.column(1).to_numpy(), b.column(2), number)

        for b in batches:
            start = 0
            ends = np.frombuffer(b.column(2).buffers()[1], dtype=np.int32, count=b.num_rows + 1, offset=4 * b.column(2).offset) if b.num_rows else np.zeros(1, dtype=np.int32)
            while start < b.num_rows:
                stop = min(b.num_rows, int(np.searchsorted(ends, int(ends[start]) + batch_bytes - size)))
                stop = max(stop, start + 1)
                waiting.append(b.slice(start, stop - start))
                size += int(ends[stop]) - int(ends[start])
                if size >= batch_bytes:
                    yield from out()
                    waiting.clear()
                    number, size = number + 1, 0
                start = stop
        if waiting:
            yield from out()

    return rows.mapInArrow(task, PACKED)


def numbers(batches: DataFrame, buckets: int) -> DataFrame:
    """Every training word's number: its place in its bucket times ``buckets``, and the bucket. Rows "own" (words, word_ids, counts) to buckets, "numbers" (local numbers, numbers plus one or 0) to batches."""

    def ask(batch, parts):
        w = _parted(parts[5])
        n, to = opened(parts[6]), _buckets(np.fromiter(map(word_id, w), dtype=np.int64, count=len(w)), buckets)
        out = []
        for bucket in np.unique(to).tolist():
            at = np.flatnonzero(to == bucket)
            out.append((bucket, "ask", batch, [_joined([w[i] for i in at]), squeezed(n[at]), _rising(at)]))
        return out

    def number(bucket, held):
        names: dict[bytes, int] = {}
        asked = [(sender, np.array([names.setdefault(x, len(names)) for x in _parted(parts[0])]), parts) for sender, parts in held["ask"]]
        n = np.zeros(len(names), dtype=np.int64)
        for _, at, parts in asked:
            n[at] += opened(parts[1])
        listed = list(names)
        order = np.array(sorted(np.flatnonzero(n).tolist(), key=listed.__getitem__), dtype=np.int64)
        no = np.zeros(len(names), dtype=np.int64)
        no[order] = np.arange(len(order)) * buckets + bucket + 1
        if len(order) * buckets >= 1 << 31:
            raise OverflowError("words of this bucket pass 31 bits")
        own = [listed[i] for i in order]
        out = [(sender, "numbers", bucket, [parts[2], squeezed(no[at])]) for sender, at, parts in asked]
        return [*out, (bucket, "own", bucket, [_joined(own), squeezed(np.fromiter(map(word_id, own), dtype=np.int64, count=len(own))), squeezed(n[order])])] if own else out

    return _grouped(_each(batches, ask), number)


def _buckets(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


class Places:
    """A batch's words and pairs in the order in which buckets know them: words by bucket and number, contexts by number, those that training has not seen last.

    ``no`` are the words' numbers, -1 for unseen ones; ``at`` and ``before`` lead from these orders to the batch's own numbers, and ``known`` words are seen.
    """

    def __init__(self, parts: list[bytes], answers: list[tuple[int, list[bytes]]], buckets: int):
        self.names = _parted(parts[5])
        self.no = np.full(len(self.names), -1)
        for _, (at, no) in answers:
            self.no[_risen(at)] = opened(no) - 1
        self.length, self.stream = opened(parts[3]), opened(parts[4])
        self.buckets, self.known = buckets, int((self.no >= 0).sum())
        unseen = self.no < 0
        self.at = np.lexsort((self.no, self.no % buckets, unseen))
        self.before = np.lexsort((self.no, unseen))
        self.place, self.place_before = (np.empty(len(x), dtype=np.int64) for x in (self.at, self.before))
        self.place[self.at] = self.place_before[self.before] = np.arange(len(self.at))

    def codes(self) -> np.ndarray:
        """Every token's pair: the word's place, and that of the one before it in the lower 32 bits. A text's end is before the next text's first word."""
        end = self.names.index(END_TOKEN)
        return self.place[self.stream] << 32 | self.place_before[np.concatenate([[end], self.stream[:-1]])]

    def seen(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> 32 < self.known) & (codes & 0xFFFFFFFF < self.known)

    def bounds(self, codes: np.ndarray) -> np.ndarray:
        """Where the pairs of each bucket begin among sorted ``codes`` of seen words."""
        first = np.searchsorted(self.no[self.at[: self.known]] % self.buckets, np.arange(self.buckets + 1))
        return np.searchsorted(codes, first << 32)


def gathered(batches: DataFrame, numbered: DataFrame, buckets: int) -> DataFrame:
    """All pairs of the batches' seen words, merged by the bucket of the word. Rows "pairs" (and "counts", these alone) to buckets, "places" (of the batch's pairs, sender) to buckets, "follows" to the contexts' buckets."""

    def send(batch, held):
        x = Places(held["batch"][0][1], held.get("numbers", []), buckets)
        codes = x.codes()
        unlearned = np.repeat(opened(held["batch"][0][1][2]) > 0, x.length)
        learned, n = np.unique(codes[~unlearned], return_counts=True)
        codes = np.union1d(learned, (more := np.unique(codes[unlearned]))[x.seen(more)])
        c = np.zeros(len(codes), dtype=np.int64)
        c[np.searchsorted(codes, learned)] = n
        u = x.before[codes & 0xFFFFFFFF]
        pair = x.no[x.at[codes >> 32]] // buckets << 32 | x.no[u]
        last = endings(x.names)[u].astype(np.int64)
        ends = x.bounds(codes)
        return [(b, "pairs", batch, [_rising(pair[i:j]), squeezed(last[i:j]), squeezed(c[i:j])]) for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if j > i]

    def merge(bucket, held):
        sent = [(sender, _risen(p[0]), opened(p[1]), opened(p[2])) for sender, p in held["pairs"]]
        codes, first, place = np.unique(np.concatenate([x[1] for x in sent]), return_index=True, return_inverse=True)
        c = np.bincount(place, np.concatenate([x[3] for x in sent]), len(codes)).astype(np.int64)
        last = np.concatenate([x[2] for x in sent])[first]
        out, at = [], 0
        for sender, p, _, _ in sent:
            out.append((bucket, "places", sender, [_rising(place[at : at + len(p)])]))
            at += len(p)
        some = c > 0
        order, u = np.unique(_by_bucket(codes[some] & 0xFFFFFFFF, buckets), return_inverse=True)
        guests, ones = np.bincount(u, c[some], len(order)).astype(np.int64), np.bincount(u, c[some] == 1, len(order)).astype(np.int64)
        many = np.bincount(u, c[some] > 1, len(order)).astype(np.int64)
        ends = np.searchsorted(order >> 32, np.arange(buckets + 1)).tolist()
        for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if j > i:
                out.append((b, "follows", bucket, [_rising(order[i:j] & 0xFFFFFFFF), squeezed(guests[i:j]), squeezed(ones[i:j]), squeezed(many[i:j])]))
        return [*out, (bucket, "pairs", bucket, [_rising(codes), squeezed(last), squeezed(c)]), (bucket, "counts", bucket, [squeezed(c)])]

    return _grouped(_grouped(batches.unionByName(numbered.where("kind = 'numbers'")), send), merge)


def _by_bucket(no: np.ndarray, buckets: int) -> np.ndarray:
    """Words' numbers as their bucket, and their place in it in the lower 32 bits."""
    return no % buckets << 32 | no // buckets


def hosts(merged: DataFrame, numbered: DataFrame) -> DataFrame:
    """The contexts' own restaurants: rows "guests" (customers, pairs with one) of a bucket's words, and "context" (word_ids, tables) to the buckets with pairs of several customers."""

    def task(bucket, held):
        ids = opened(held["own"][0][1][1])
        guests, ones, tables = np.zeros((3, len(ids)), dtype=np.int64)
        for _, p in held.get("follows", []):
            at = _risen(p[0])
            guests[at] += opened(p[1])
            ones[at] += (one := opened(p[2]))
            tables[at] += one + opened(p[3])
        out = [(bucket, "guests", bucket, [squeezed(guests), squeezed(ones)])]
        for sender, p in held.get("follows", []):
            at = _risen(p[0])[opened(p[3]) > 0]
            if len(at):
                out.append((sender, "context", bucket, [squeezed(ids[at]), squeezed(tables[at])]))
        return out

    return _grouped(merged.where("kind = 'follows'").unionByName(numbered.where("kind = 'own'")), task)


class Bucket(NamedTuple):
    """A bucket's words with their seatings in the endings' restaurants and the root, and their pairs of several customers."""

    words: list[bytes]
    ids: np.ndarray
    n: np.ndarray  # occurrences
    endings: np.ndarray  # how many endings' restaurants the word is in
    ctx: np.ndarray  # those, word by word
    alone: np.ndarray  # the customers that come there from pairs with one
    c: np.ndarray  # all customers there
    t: np.ndarray  # and tables
    rt: np.ndarray  # tables in the root
    p: np.ndarray  # what spelling gives the word
    was_c: np.ndarray  # the sample before: empty until there are two
    was_t: np.ndarray
    was_rt: np.ndarray
    at: np.ndarray  # every pair's place in ``ctx``
    by: np.ndarray  # every pair's context, as a place in ``u``
    pair_c: np.ndarray
    pair_t: np.ndarray
    was_pair_t: np.ndarray
    u: np.ndarray  # contexts of these pairs as ``_by_bucket``, in order
    u_ids: np.ndarray
    u_tables: np.ndarray  # the tables of all words in the context's restaurant

    def packed(self) -> list[bytes]:
        return [_joined(self.words), *(squeezed(x) for x in self[1:])]

    @classmethod
    def of(cls, parts: list[bytes], only: str = "") -> Bucket:
        """The bucket, or its fields named in ``only``."""
        some = only.split() or cls._fields
        return cls(*(None if name not in some else opened(p) if i else _parted(p) for i, (name, p) in enumerate(zip(cls._fields, parts, strict=True))))

    def first(self) -> np.ndarray:
        return np.cumsum(self.endings) - self.endings

    def sent(self, buckets: int, tables: np.ndarray) -> list[tuple[int, list[bytes]]]:
        """The pairs' ``tables`` summed by context, for each bucket of contexts."""
        total = np.bincount(self.by, tables, len(self.u)).astype(np.int64)
        ends = np.searchsorted(self.u >> 32, np.arange(buckets + 1)).tolist()
        return [(b, [_rising(self.u[i:j] & 0xFFFFFFFF), squeezed(total[i:j])]) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]


def opening(merged: DataFrame, numbered: DataFrame, contexts: DataFrame, buckets: int) -> DataFrame:
    """Rows "bucket" with a table for every pair, and no other seating yet."""

    def task(bucket, held):
        own = held["own"][0][1]
        w, ids, n = _parted(own[0]), opened(own[1]), opened(own[2])
        codes, last, c = _risen((p := held["pairs"][0][1])[0]), opened(p[1]), opened(p[2])
        some = c > 0
        cell, at = np.unique(codes[some] >> 32 << 8 | last[some], return_inverse=True)
        many = c[some] > 1
        alone = np.bincount(at[~many], minlength=len(cell))
        at = at[many]
        u, by = np.unique(_by_bucket(codes[some][many] & 0xFFFFFFFF, buckets), return_inverse=True)
        answers = [x for _, x in held.get("context", [])]  # by the contexts' buckets, so in the order of u
        u_ids, u_tables = (np.concatenate([np.zeros(0, dtype=np.int64), *(opened(x[i]) for x in answers)]) for i in range(2))
        one, none = np.ones(len(at), dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = Bucket(w, ids, n, np.bincount(cell >> 8, minlength=len(w)), cell & 255, alone, alone + np.bincount(at, minlength=len(cell)), np.ones(len(cell), dtype=np.int64), np.ones(len(w), dtype=np.int64), np.zeros(0), none, none, none, at, by, c[some][many], one, one, u, u_ids, u_tables)
        return [(bucket, "bucket", bucket, first.packed())]

    return _grouped(merged.where("kind = 'pairs'").unionByName(numbered.where("kind = 'own'")).unionByName(contexts.where("kind = 'context'")), task)


def _sums(state: DataFrame, task: Callable[[Bucket], np.ndarray], n: int, only: str) -> np.ndarray:
    """``task``'s ``n`` numbers summed over all buckets, of which it gets the fields ``only``."""

    def run(_, parts):
        import pyarrow as pa

        return pa.table({"i": pa.array(np.arange(n, dtype=np.int32)), "n": pa.array(task(Bucket.of(parts, only)).astype(np.float64))})

    out = np.zeros(n)
    for r in _each(state, run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out


def _totals(state: DataFrame) -> tuple[Totals, np.ndarray]:
    """The totals of all buckets' seatings; and words, tokens, what spelling gives all words, and how many are in one ending's restaurant and in two, have one customer there and two, and pairs with two."""

    def task(b):
        counts = (len(b.n), b.n.sum(), b.p.sum(), *((x == k).sum() for x in (b.endings, b.c) for k in (1, 2)), (b.pair_c == 2).sum(), b.alone.sum())
        return np.concatenate([np.bincount(b.ctx, b.t, CONTEXTS), np.bincount(b.ctx, b.c, CONTEXTS), [b.t.sum(), b.rt.sum()], np.array(counts, dtype=np.float64)])

    got = _sums(state, task, 2 * CONTEXTS + 11, "n endings ctx alone c t rt p pair_c")
    whole = np.rint(got[: 2 * CONTEXTS + 2]).astype(np.int64)
    return Totals(whole[:CONTEXTS], int(whole[-2]), int(whole[-1]), whole[CONTEXTS : 2 * CONTEXTS]), got[2 * CONTEXTS + 2 :]


def _root(c: np.ndarray, rt: np.ndarray, p0: np.ndarray, totals: Totals, d0: float) -> np.ndarray:
    """The root's probability of words with ``c`` customers and ``rt`` tables there."""
    return (c - d0 * rt + (STRENGTH + d0 * totals.root) * p0) / (STRENGTH + totals.customers)


def _followed(b: Bucket, totals: Totals, discount: tuple[float, float, float], turn: int) -> Bucket:
    """The bucket after a sweep of the whole words' restaurants; the endings' customers are counted anew."""
    d0, d1, d2 = discount
    root = _root(np.add.reduceat(b.t, b.first()), b.rt, b.p, totals, d0)
    guests = STRENGTH + totals.guests[b.ctx]
    p = (b.c - d1 * b.t) / guests + (STRENGTH + d1 * totals.tables[b.ctx]) / guests * np.repeat(root, b.endings)
    with np.errstate(over="ignore"):
        key = np.repeat(b.ids, b.endings)[b.at].view(np.uint64) + (b.u_ids[b.by].view(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
    t = drawn_tables(key, b.pair_c, np.maximum(0, b.u_tables[b.by] - b.pair_t), p[b.at], d2, 1000 * (turn + 1) + 1)
    return b._replace(pair_t=t, was_pair_t=b.pair_t, was_c=b.c, c=b.alone + np.bincount(b.at, t, len(b.ctx)).astype(np.int64))


def _seated(b: Bucket, turn: int, totals: Totals, p0: np.ndarray, discount: tuple[float, float, float]) -> Bucket:
    """The bucket after a sweep of the endings' restaurants and the root, of which spelling, ``p0``, is the parent."""
    from xxhash import xxh64_intdigest

    d0, d1, _ = discount
    key = np.array([xxh64_intdigest(x, 42) for x in b.words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        pair = np.repeat(key, b.endings) + (b.ctx.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
    p = np.repeat(_root(np.add.reduceat(b.t, b.first()), b.rt, p0, totals, d0), b.endings)
    t = drawn_tables(pair, b.c, np.maximum(0, totals.tables[b.ctx] - b.t), p, d1, 1000 * (turn + 1))
    rt = drawn_tables(key, np.add.reduceat(t, b.first()), np.maximum(0, totals.root - b.rt), p0, d0, 1000 * (turn + 1))
    return b._replace(t=t, rt=rt, p=p0, was_t=b.t, was_rt=b.rt)


def _tables_of_contexts(state: DataFrame, numbered: DataFrame, contexts: DataFrame, buckets: int) -> DataFrame:
    """Rows "context" as in ``hosts``, by the pairs' tables as they are now; without word_ids."""

    def send(bucket, parts):
        b = Bucket.of(parts, "u by pair_t")
        return [(to, "sum", bucket, p) for to, p in b.sent(buckets, b.pair_t)]

    def answer(bucket, held):
        tables = opened(held["guests"][0][1][1]).copy()
        for _, p in held.get("sum", []):
            tables[_risen(p[0])] += opened(p[1])
        return [(sender, "context", bucket, [squeezed(tables[_risen(p[0])])]) for sender, p in held.get("sum", [])]

    return _grouped(_each(state, send).unionByName(contexts.where("kind = 'guests'")), answer)


class Learned(NamedTuple):
    """What ``fit`` leaves, packed by bucket, for scoring."""

    state: DataFrame
    numbered: DataFrame
    merged: DataFrame
    contexts: DataFrame
    buckets: int


class Model(NamedTuple):
    words: DataFrame  # (w, word, c, one, two, ctx binary, q binary, guests, tables): word_id, word, count, root probabilities by sample, seen endings and -Q log10 of the mean probabilities in them; the word's own restaurant's customers and mean tables
    pairs: DataFrame  # (w, u, c, t): customers and mean tables of the word w in the restaurant of the word u
    tokens: int
    distinct: int
    discount: tuple[float, float, float]  # root, endings, whole words
    totals: tuple[Totals, Totals]
    unknown: float  # what spelling leaves to unseen words
    learned: Learned

    def root_unknown(self) -> np.ndarray:
        """The root's probability of the unseen words, by sample."""
        return np.array([(STRENGTH + self.discount[0] * t.root) * self.unknown / (STRENGTH + t.customers) for t in self.totals])

    def shares(self) -> np.ndarray:
        """What every context leaves to the root, by [sample, context]."""
        return np.stack([(STRENGTH + self.discount[1] * t.tables) / (STRENGTH + t.guests) for t in self.totals])


def _finished(b: Bucket, totals: tuple[Totals, Totals], discount: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, two, q): the words' root probabilities by sample, and -Q log10 of their mean probabilities in ``ctx``."""
    d0, d1, _ = discount
    seated = ((b.was_c, b.was_t, b.was_rt), (b.c, b.t, b.rt))
    root = [_root(np.add.reduceat(t, b.first()), rt, b.p, whole, d0) for whole, (_, t, rt) in zip(totals, seated, strict=True)]
    q = np.zeros(len(b.ctx))
    for r, whole, (c, t, _) in zip(root, totals, seated, strict=True):
        guests = STRENGTH + whole.guests[b.ctx]
        q += ((c - d1 * t) / guests + (STRENGTH + d1 * whole.tables[b.ctx]) / guests * np.repeat(r, b.endings)) / 2
    return root[0].astype(np.float32), root[1].astype(np.float32), np.minimum(65_535, np.rint(-np.log10(q) * Q)).astype(np.int64)


def _hosted(held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(customers, twice the mean tables) of the words' own restaurants, from a bucket's rows "guests" and "sum"."""
    guests, tables = opened(held["guests"][0][1][0]), 2 * opened(held["guests"][0][1][1])
    for _, p in held.get("sum", []):
        tables[_risen(p[0])] += opened(p[1])
    return guests, tables


def _known(state: DataFrame, contexts: DataFrame, buckets: int, totals: tuple[Totals, Totals], discount: tuple[float, float, float]) -> DataFrame:
    """Rows "guests" and "sum", as ``_hosted`` takes them, and "done" (counts, one, two, q of ``_finished`` and its contexts, and twice the pairs' mean tables)."""

    def send(bucket, parts):
        b = Bucket.of(parts)
        one, two, q = _finished(b, totals, discount)
        t = b.pair_t + b.was_pair_t
        done = [squeezed(x) for x in (b.n, one, two, q, b.endings, b.ctx, t)]
        return [(bucket, "done", bucket, done), *((to, "sum", bucket, p) for to, p in b.sent(buckets, t))]

    return contexts.where("kind = 'guests'").unionByName(_each(state, send))


def fit(train: DataFrame, text_col: str = "text", seed: int = 11, batch_bytes: int = 12_000_000) -> Model:
    """Learn from every row of ``train``."""
    rows = train.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return _fit(*_batches(rows, batch_bytes), seed)


def _batches(rows: DataFrame, batch_bytes: int) -> tuple[DataFrame, int]:
    """``batched``, stored, and a number of buckets for its words."""
    batches = stored(batched(rows.withColumn("text", F.coalesce("text", F.lit("").cast("binary"))), batch_bytes))
    size = batches.agg(F.coalesce(F.sum(F.octet_length(F.col("parts")[4])), F.lit(0))).first()[0]
    return batches, max(1, -(-int(size) // 2_500_000))


def _fit(batches: DataFrame, buckets: int, seed: int) -> Model:
    """Number the words and gather the pairs, then let the pairs', the words' and the spelling model's seatings take turns.

    At first every pair has one table, and the first spelling model sees one table a word,
    the second the root's tables after the first turn. Three sweeps follow each other, of
    which the first leaves the pairs; the seatings after the second and the third are the samples.
    """
    spark = batches.sparkSession
    numbered = stored(numbers(batches, buckets))
    merged = stored(gathered(batches, numbered, buckets))
    contexts = stored(hosts(merged, numbered))
    state = stored(opening(merged, numbered, contexts, buckets))
    totals, (distinct, tokens, _, *few) = _totals(state)
    # the discounts by how many dishes have one customer and how many two
    discount = tuple(min(0.95, max(0.1, one / max(1, one + 2 * two))) for one, two in (few[:2], few[2:4], (few[5], few[4])))

    def spelt(state, lut, seed):
        def task(_, parts):
            import pyarrow as pa

            b = Bucket.of(parts, "words rt")
            return pa.table({"word": pa.array(b.words, pa.binary()), "t": pa.array(b.rt)})

        tables = _each(state, task, "word binary, t long")
        lut = symbols(tables) if lut is None else lut
        return lut, spark.sparkContext.broadcast(spelling(tables, lut, seed=seed))

    lut, speller = spelt(state, None, seed)
    seen = []
    for turn in range(3):
        last = state
        if turn == 1:
            lut, speller = spelt(state, lut, seed + 1)

        def task(bucket, parts, tables=None, turn=turn, totals=totals, speller=speller):
            b = Bucket.of(parts)
            if tables is not None:
                b = b._replace(u_tables=tables)
            if turn:
                b = _followed(b, totals, discount, turn)
            p0 = b.p if turn == 2 else 10.0 ** np.maximum(-300.0, log10_spelling(b.words, speller.value))
            return [(bucket, "bucket", bucket, _seated(b, turn, totals, p0, discount).packed())]

        if turn < 2:
            state = stored(_each(state, task))
        else:
            answers = _tables_of_contexts(state, numbered, contexts, buckets)
            state = stored(_grouped(state.unionByName(answers), lambda bucket, held, task=task: task(bucket, held["bucket"][0][1], np.concatenate([np.zeros(0, dtype=np.int64), *(opened(p[0]) for _, p in held.get("context", []))]))))
        discard(last)
        totals, (*_, given, _, _, _, _, _, _) = _totals(state)
        seen.append(totals)
    samples, left = (seen[1], seen[2]), max(1e-12, 1.0 - float(given))

    def listed(bucket, held):
        import pyarrow as pa

        b = Bucket.of(held["bucket"][0][1], "words ids")
        n, one, two, q, many, ctx, _ = map(opened, held["done"][0][1])
        guests, tables = _hosted(held)
        return pa.table({"no": pa.array(np.arange(len(b.words)) * buckets + bucket), "w": pa.array(b.ids), "word": pa.array(b.words, pa.binary()), "c": pa.array(n), "one": pa.array(one), "two": pa.array(two), "ctx": _packed(ctx, many, "u1"), "q": _packed(q, many, "<u2"), "guests": pa.array(guests), "tables": pa.array(tables / 2)})

    def paired(bucket, held):
        import pyarrow as pa

        b, (codes, _, c) = Bucket.of(held["bucket"][0][1]), held["pairs"][0][1]
        codes, c = _risen(codes)[opened(c) > 0], opened(c)[opened(c) > 0]
        t = np.ones(len(c))
        t[c > 1] = (b.pair_t + b.was_pair_t) / 2
        return pa.table({"w": pa.array(b.ids[codes >> 32]), "no": pa.array(codes & 0xFFFFFFFF), "c": pa.array(c), "t": pa.array(t)})

    every = _grouped(state.unionByName(_known(state, contexts, buckets, samples, discount)), listed, "no long, w long, word binary, c long, one float, two float, ctx binary, q binary, guests long, tables double")
    pairs = _grouped(state.unionByName(merged.where("kind = 'pairs'")), paired, "w long, no long, c long, t double")
    pairs = pairs.join(every.select("no", F.col("w").alias("u")), "no").select("w", "u", "c", "t")
    return Model(every.drop("no"), pairs, int(tokens), int(distinct), discount, samples, left, Learned(state, numbered, merged, contexts, buckets))


class Seen:
    """Where a word's contexts stand among all: a bit for each context of a word, and how many are set before."""

    def __init__(self, ctx: np.ndarray, n: np.ndarray):
        width = CONTEXTS // 64
        self.bits = np.zeros(((len(n) + 1) * width,), dtype=np.uint64)  # the last word is the unseen one
        cell = np.repeat(np.arange(len(n)), n) * width + (ctx >> 6)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(starts):
            self.bits[cell[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (ctx & 63).astype(np.uint64), starts)
        count = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(count) - count

    def places(self, word: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word's context, has it that?)."""
        cell, bit = word * (CONTEXTS // 64) + (ctx >> 6), np.uint64(1) << (ctx & 63).astype(np.uint64)
        bits = self.bits[cell]
        return self.before[cell] + np.bitwise_count(bits & (bit - np.uint64(1))), (bits & bit) != 0


def _answers(model: Model) -> DataFrame:
    """Rows "answer" to batches: their words of a bucket, in the order of ``Places``, with what ``_known`` has of them, and customers and tables of their pairs."""
    state, numbered, merged, contexts, buckets = model.learned
    samples, discount = model.totals, model.discount

    def answer(bucket, held):
        if "done" not in held:  # no word of it is seen
            return []
        n, one, two, q, many, ctx, both = map(opened, held["done"][0][1])
        guests, tables = _hosted(held)
        first, c = np.cumsum(many) - many, opened(held["counts"][0][1][0])
        t = np.where(c == 1, 2, 0)
        t[c > 1] = both
        places, out = {sender: p[0] for sender, p in held.get("places", [])}, []
        for sender, p in held.get("numbers", []):
            no = opened(p[1])
            at = np.sort(no[no > 0] - 1) // buckets
            if len(at):
                cells = _ragged(first[at], many[at])
                pairs = _risen(places[sender]) if sender in places else c[:0]
                columns = (n[at], one[at], two[at], many[at], ctx[cells], q[cells], guests[at], tables[at], c[pairs], t[pairs])
                out.append((sender, "answer", bucket, [squeezed(y) for y in columns]))
        return out

    asked = numbered.where("kind = 'numbers'").select(F.col("sender").alias("to"), "kind", F.col("to").alias("sender"), "parts")
    return _grouped(_known(state, contexts, buckets, samples, discount).unionByName(asked).unionByName(merged.where("kind in ('counts', 'places')")), answer)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 12_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    ``held_out`` is a boolean Column over ``doc_id``; rows where it is not true are
    learned from. ``score`` is the model's log10 probability of the text's words and
    its end, ``base_score`` that of the smoothed word counts, ``perplexity`` the
    score's, a token. A null or empty text is its end alone. Without training rows the
    counts are 0 and every word is the unseen one. Repeated rows give repeated results;
    an empty table gives no rows. A text must fit into a task's memory; time grows with
    its length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    batches, buckets = _batches(rows, batch_bytes)
    model = _fit(batches, buckets, 11)
    n, unknown, shares, d2 = model.tokens, model.root_unknown(), model.shares(), model.discount[2]
    norm = float(np.log10(n + 0.1 * (model.distinct + 1)))
    answers = stored(_answers(model))
    for done in (model.learned.state, model.learned.merged, model.learned.contexts):
        discard(done)

    def scored(_, held):
        import pyarrow as pa

        parts = held["batch"][0][1]
        x = Places(parts, held.get("numbers", []), buckets)
        none = [[squeezed(np.zeros(0, dtype=kind)) for kind in ("i8", "f4", "f4", *["i8"] * 7)]]
        c, one, two, many, ctx, q, guests, tables, pair_c, pair_t = (np.concatenate([opened(y) for y in column]) for column in zip(*[p for _, p in held.get("answer", [])] or none, strict=True))
        c, guests, tables, k = np.append(c, 0), np.append(guests, 0), np.append(tables, 0) / 2, x.known  # the last is the unseen word
        root = np.stack([np.append(y, u) for y, u in zip((one, two), unknown, strict=True)])
        back = (STRENGTH + d2 * tables) / (STRENGTH + guests)  # what the word's restaurant leaves to its ending's; all, if it has no customers
        back[guests == 0] = 1.0
        seen, q, base = Seen(ctx, many), np.append(q, 0), np.log10(c + 0.1) - norm
        pairs, token = np.unique(x.codes(), return_inverse=True)
        own, p = np.zeros(len(pairs)), np.zeros(len(pairs))
        own[x.seen(pairs)] = pair_c - d2 * pair_t / 2
        last = endings(x.names).astype(np.int64)
        for i in range(0, len(pairs), 200_000):
            some = pairs[i : i + 200_000]
            at, u = np.minimum(some >> 32, k), x.before[some & 0xFFFFFFFF]
            end, before = last[u], np.minimum(x.place[u], k)
            y = np.log10((shares[:, end] * root[:, at]).mean(axis=0))
            place, hit = seen.places(at, end)
            y[hit] = q[place[hit]] / -Q
            p[i : i + 200_000] = np.log10(own[i : i + 200_000] / (STRENGTH + guests[before]) + back[before] * 10.0**y)
        first, at = np.cumsum(x.length) - x.length, np.minimum(x.place, k)[x.stream]
        sums = [np.add.reduceat(y, first) for y in ((c[at] > 0).astype(np.int64), base[at], p[token])]
        ids = pa.array(opened(parts[0]), mask=opened(parts[1]) == 0)
        return pa.table([ids, pa.array(opened(parts[2]) > 0), *map(pa.array, (x.length, *sums))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    asked = model.learned.numbered.where("kind = 'numbers'")
    done = _grouped(batches.unionByName(asked).unionByName(answers), scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    slim(spark)
    tidy(spark)
    return score(table(spark, sf_dir, "documents"), residue("doc_id", 10) == 0)
