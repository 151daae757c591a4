"""Operator 8: packing documents into fixed-length sequences.

Documents are tokenized, closed by an end id and, if too long, cut; what has to be
packed is a multiset of piece lengths below the capacity. Equal lengths are
interchangeable, so the instance is its histogram, at most ``capacity`` counts at
any corpus size, which Spark aggregates. On it the Martello-Toth reduction fixes
sets that dominate every alternative; the rest is packed best-fit in decreasing
order. Both work on counts: a step fills many equal sequences at once. The plan
(ranges of equal pieces to ranges of sequences) is bounded by the square of the
capacity and is applied to pieces numbered within their length by Spark.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import cut, gapless, resident, sliced

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str) -> ChunkEncoder:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    vocabulary = tok.get_vocab()
    opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte alphabet's space

    def led(chunks: list[str]) -> list[bytes]:
        """Chunks encoded as one text and parted at the tokens that open with a space, one a chunk."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids = np.array(tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            bounds, raw = [*(4 * np.flatnonzero(opens[ids])).tolist(), 4 * len(ids)], ids.tobytes()
            out.extend(raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
        return out

    return ChunkEncoder(lambda texts: [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)], encode_led=led)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's tokens and end id, cut where over ``capacity``.

    Only a longer document's first piece is shorter than ``capacity``. A null text
    is empty: one piece holding the end id.
    """

    def task(batches):
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, end = resident(("packing", path), lambda: encoder(path)), array("I", [end_id]).tobytes()
        for part in sliced(batches, 256):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, body in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                packed = body + end
                n = len(packed) // 4
                cuts = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, x in zip(rows, (doc, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, PIECES)


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth dominance on a histogram: (fixed sets with how often each), what remains.

    Largest length first: a length that nothing fits beside stands alone; an exact
    partner dominates; if only one more piece of any length fits, the longest that
    fits dominates; if two fit but no two are longer together than the best single
    partner, that partner dominates.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(members: tuple[int, ...], times: int) -> None:
        fixed.append((members, times))
        for s in members:
            left[s] -= times
            if not left[s]:
                del left[s]

    moved = True
    while moved:
        moved = False
        for s in sorted(left, reverse=True):
            while s in left:
                rest = {t: n - (t == s) for t, n in left.items() if n > (t == s)}
                room = capacity - s
                fits = sorted(t for t in rest if t <= room)
                if not fits:
                    take((s,), left[s] if s + min(left) > capacity else 1)
                    moved = True
                    continue
                best = fits[-1]
                small = [t for t in fits[:3] for _ in range(min(3, rest[t]))][:3]
                alone = len(small) < 2 or small[0] + small[1] > room
                if not alone and best != room and (len(small) < 3 or sum(small) > room):
                    pair = max((a + b for a in fits for b in [max((b for b in fits if b <= room - a and (b != a or rest[a] > 1)), default=None)] if b is not None), default=0)
                    alone = best >= pair
                if not alone and best != room:
                    break
                take((s, best), left[s] // 2 if s == best else min(left[s], left[best]))
                moved = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: kinds of sequences with how often each occurs."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                per = capacity // s
                for times, k in ((n // per, per), (1, n % per)):
                    if times and k:
                        open_.setdefault(capacity - k * s, []).append(((s,) * k, times))
                break
            members, times = open_[room].pop()
            used = min(n, times)
            if times > used:
                open_[room].append((members, times - used))
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - s, []).append(((*members, s), used))
            n -= used
    return [x for kinds in open_.values() for x in kinds]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first ordinal, count, first sequence, offset), ordered by length and ordinal."""
    fixed, rest = reduce(counts, capacity)
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for members, times in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for s in members:
            rows.append((s, given.get(s, 0), times, sequence, offset))
            given[s] = given.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` plus (sequence_id, offset): every piece's sequence and its place there.

    Sequences hold at most ``capacity`` ids and are filled from offset 0 without
    gaps. Equal pieces are placed in an order fixed by (doc_id, piece, crc32).
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, path, capacity, end_id, id_col, text_col))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    numbered = gapless(cuts, "length", ["doc_id", "piece", "ids_crc32"], "_ordinal", sum(counts.values()))
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches):
        import pyarrow as pa

        rows = shared.value
        width = int(rows[:, 2].sum()) + 1
        key = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, length * width + ordinal, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows[at, 3] + ordinal - rows[at, 1]), pa.array(rows[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "_ordinal").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))
