"""Encoding of whole texts through a bounded memo of their space-separated parts.

Byte-level BPE with the usual pattern never joins characters across "word, space, word", so the ids of
a text are those of its parts ``' ' + part``, one after the other.  That holds at each space unless
white space stands on both sides of it (or it ends a run at the text's end); texts with such a run are
encoded in one piece.  Words repeat, so most parts are found in the memo.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space between two white-space characters, or after one at the end of the text.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


class Memo(dict):
    """part -> little-endian ids; emptied when it holds about ``limit`` bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 160 << 20):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0

    def fill(self, parts: set[str], prefix: str = " ") -> None:
        """Encodes what is missing, many parts at a time."""
        missing = [p for p in parts if p not in self]
        if not missing:
            return
        if self.held > self.limit:
            keep = {p: self[p] for p in parts if p in self}
            self.clear()
            self.update(keep)
            self.held = sum(200 + 2 * len(p) for p in keep)
        for p, ids in zip(missing, self.encode([prefix + p for p in missing]), strict=True):
            self[p] = ids
            self.held += 200 + 2 * len(p) + len(ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split, whole, firsts = [], [], set()
        for t in texts:
            if UNSAFE.search(t):
                split.append(None)
                whole.append(t)
            else:
                split.append(parts := t.split(" "))
                firsts.add(parts[0])
        parts_of = [x for x in split if x is not None]
        firsts = list(firsts)
        first = dict(zip(firsts, self.encode(firsts), strict=True))
        done_whole = iter(self.encode(whole))
        seen: set[str] = set()
        for parts in parts_of:
            seen.update(parts[1:])
        self.fill(seen)
        get = self.__getitem__
        out = []
        for parts in split:
            if parts is None:
                out.append(next(done_whole))
            else:
                head = first[parts[0]]
                del parts[0]
                out.append(head + b"".join(map(get, parts)))
        return out
