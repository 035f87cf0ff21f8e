"""Whole texts to token ids by way of their chunks between ASCII white space.

A vocabulary whose pre-tokens never span white space gives a text the ids of its chunks in
order, so each distinct chunk is encoded once per worker and texts become joins of byte
strings. Ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice


# Lead bytes of U+0300 to U+036F. An ASCII letter composes with no other sign, and capitals may lack a composite their
# small letters have, so texts with these are not folded before they are normalised.
COMPOSING = (b"\xcc", b"\xcd")


class ChunkIds:
    """The ids of chunks as bytes, computed in batches and remembered up to ``limit`` entries.

    ``encode`` takes a list of chunks and gives each one's ids as bytes; it must not tell upper
    from lower ASCII case in texts that hold none of ``cased`` or COMPOSING. When full, the younger half is
    forgotten: chunks met early are the frequent ones.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], cased: tuple[bytes, ...] = (), limit: int = 800_000):
        self.encode, self.cased, self.limit = encode, (*cased, *COMPOSING), limit
        self.chunks: dict[bytes, bytes] = {}

    def _forget(self) -> None:
        if len(self.chunks) > self.limit:
            for chunk in list(islice(reversed(self.chunks), len(self.chunks) - self.limit // 2)):
                del self.chunks[chunk]

    def of_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; null counts as empty."""
        self._forget()
        words = []
        for text in texts:
            data = (text or "").encode()
            words.append((data if any(sign in data for sign in self.cased) else data.lower()).split())
        flat = [c for ws in words for c in ws]
        ids = list(map(self.chunks.get, flat))
        holes = [i for i, found in enumerate(ids) if found is None]
        if holes:
            new = list({flat[i] for i in holes})
            learnt = dict(zip(new, self.encode([c.decode() for c in new])))
            for i in holes:
                ids[i] = learnt[flat[i]]
            self.chunks.update(learnt)
        out, at = [], 0
        for ws in words:
            out.append(b"".join(ids[at : at + len(ws)]))
            at += len(ws)
        return out
