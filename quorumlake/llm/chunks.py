"""Memoised byte-pair encoding of whole texts by space-led chunks.

The tokenizers' pattern never lets a token reach over a single space that stands
between two characters that aren't white space: the space opens the next token.
A text can hence be split at its spaces and each ``" chunk"`` encoded apart, with
the ids of frequent chunks remembered. Texts in which white space meets white
space are encoded whole, by the same encoder, so that results are always exact.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable


class _Memo(dict):
    """Known chunks; unknown ones are noted in ``new``. ``old`` is the generation before."""

    def __init__(self, old: dict):
        super().__init__()
        self.old, self.new = old, []

    def __missing__(self, chunk: str) -> bytes | None:
        known = self.old.get(chunk)
        if known is None:
            self.new.append(chunk)
        self[chunk] = known
        return known


class ChunkEncoder:
    """``encode_many`` maps strings to their ids as packed little-endian uint32 bytes.

    ``encode_led`` does so for chunks that a space opens and that hold no other space,
    if there is a faster way for many of them at once.
    At most two generations of ``limit`` chunks are remembered; a chunk that is
    used again moves to the younger one.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 500_000, longest: int = 48, encode_led: Callable[[list[str]], list[bytes]] | None = None):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.encode_led = encode_led or encode_many
        self.memo = _Memo({})

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.limit:
            self.memo.old = {}
            self.memo = _Memo(self.memo)
        memo = self.memo
        split = [t.split(" ") for t in texts]
        for parts in split:
            deque(map(memo.__getitem__, parts[1:-1]), maxlen=0)
        noted, memo.new = memo.new, []
        new = [c for c in noted if c and not (c[0].isspace() or c[-1].isspace())]  # others stay None
        memo.update(zip(new, self.encode_led([" " + c for c in new]), strict=True))
        edges = list(dict.fromkeys(x for parts in split for x in ((parts[0], " " + parts[-1]) if len(parts) > 1 else (parts[0],))))
        edge = dict(zip(edges, self.encode_many(edges), strict=True))
        out: list[bytes | None] = []
        for parts in split:
            if len(parts) == 1:
                out.append(edge[parts[0]])
                continue
            try:
                if parts[0][-1:].isspace():
                    raise TypeError
                out.append(b"".join((edge[parts[0]], *map(memo.__getitem__, parts[1:-1]), edge[" " + parts[-1]])))
            except TypeError:  # white space beside white space
                out.append(None)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(whole, self.encode_many([texts[i] for i in whole]), strict=True):
            out[i] = x
        for c in [c for c in new if len(c) > self.longest]:
            del memo[c]
        return out
