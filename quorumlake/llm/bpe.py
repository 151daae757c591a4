"""Operator 4: byte-level BPE encoding and decoding.

Vocabulary tokens are added to a pyahocorasick automaton as Latin-1 strings, one
character per byte. One pass over a pre-token yields the longest vocabulary match
at every position. The encoder walks left to right, takes the longest match that
is *compatible* with the token before it, falls back to the longest shorter
prefix token, and backtracks when none is left; positions proved dead are never
tried again, so the work is linear in the pre-token. Two adjacent tokens are
compatible if merging their joint bytes by rank gives back exactly the two; the
answer is memoised per pair. A sequence whose neighbours are all compatible is
the one that BPE's merges produce.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import resident

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.text = ChunkEncoder(self._many)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairCoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank; only for the joint bytes of two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[pair] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest: list[int] = [0] * len(piece)
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - n] = token  # ends ascend, so the longest stays
        dead, out, at, token = set(), [], 0, longest[0]
        size, compatible = self.size, self.compatible
        while True:
            end = at + size[token]
            if end not in dead and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            elif (less := self.prefix(token)) is not None:
                token = less
            else:  # nothing fits here after what stands before
                dead.add(at)
                token = out.pop()
                at -= size[token]

    def _many(self, texts: list[str]) -> list[bytes]:
        return [array("I", [i for m in self.find(t) for i in self.encode_piece(m.encode())]).tobytes() for t in texts]

    def encode(self, text: str) -> list[int]:
        return array("I", self.text([text])[0]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def coder(path: str, pattern: str) -> BytePairCoder:
    return BytePairCoder.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts: (doc_id, ids array<int>, decoded binary), or their digests.

    ``path`` is a vocabulary of base64 tokens and ranks, ``pattern`` the
    pre-token pattern; both are read on the executors, where the path must exist.
    With ``with_ids=False`` the rows are (doc_id, n_tokens, ids_sha256,
    decoded_sha256) and no id list leaves the task. A null or empty text has no
    ids; repeated rows give repeated results; an empty table gives no rows.
    """

    def task(batches):
        import pyarrow as pa

        bpe = resident(("bpe", path, pattern), lambda: coder(path, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = bpe.text([t or "" for t in part.column(1).to_pylist()])
                ids = [array("I", p) for p in packed]
                plain = [bpe.decode(i) for i in ids]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array(plain, pa.binary())], ["doc_id", "ids", "decoded"])
                else:
                    cols = [[len(i) for i in ids], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(p).hexdigest() for p in plain]]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>, decoded binary" if with_ids else RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, with_ids=False)
