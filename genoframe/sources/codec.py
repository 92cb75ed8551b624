"""What the binary containers are made of, with numpy: fixed values, unpacking and name trees."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right

import numpy as np

from genoframe.functions.alphabet import IUB_CODES, NIBBLE_ORDER, TWOBIT_ORDER

# -- fixed values of the formats -------------------------------------------------
TWOBIT_MAGIC = 0x1A412743
FOURBIT_MAGIC = b"4BIT"
TWOBE_MAGIC = b"2BE1"
IUB_TRAILER = b"2B2U"
PTR_FOOTER = b"INDX"
BPT_FOOTER = b"BPTX"
TREE_FANOUT = 256

EDIT = np.dtype([("pos", "<u4"), ("len", "<u4"), ("etype", "u1"), ("code", "u1")])


def _table(order: str, other: int) -> np.ndarray:
    t = np.full(256, other, np.uint8)
    for i, c in enumerate(order):
        t[ord(c)] = t[ord(c.lower())] = i
    return t


TO_TWO = _table(TWOBIT_ORDER, 0)
TO_NIBBLE = _table(NIBBLE_ORDER, 15)
FROM_TWO = np.frombuffer(TWOBIT_ORDER.encode(), np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]
FROM_NIBBLE = np.frombuffer(NIBBLE_ORDER.encode(), np.uint8)[(np.arange(256)[:, None] >> np.array([4, 0])) & 15]
PLAIN = np.isin(np.arange(256), list(b"ACGTacgt"))
LOWER = (np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))
CODE = np.zeros(256, np.uint8)
for _c in IUB_CODES:
    CODE[ord(_c)] = CODE[ord(_c.lower())] = ord(_c)


def as_bytes(bases: str | bytes) -> np.ndarray:
    """One byte a base; other characters are junk of one byte each."""
    return np.frombuffer(bases if isinstance(bases, bytes) else bases.encode("latin-1", "replace"), np.uint8)


def unpack2(packed: bytes, skip: int, n: int) -> np.ndarray:
    return FROM_TWO[np.frombuffer(packed, np.uint8)].reshape(-1)[skip : skip + n].copy()


def unpack4(packed: bytes, skip: int, n: int) -> np.ndarray:
    return FROM_NIBBLE[np.frombuffer(packed, np.uint8)].reshape(-1)[skip : skip + n].copy()


def lay(window: np.ndarray, start: int, starts: np.ndarray, sizes: np.ndarray, values=None, small: np.ndarray | None = None) -> None:
    """Write blocks over a window that begins at ``start``: ``values`` is a code for all or
    one for each block; without any, bases are lower-cased, by the table ``small`` where the
    window may hold what is no letter. Blocks don't overlap."""
    low = np.maximum(starts, start) - start
    n = np.minimum(starts + sizes, start + len(window)) - start - low
    keep = n > 0
    low, n = low[keep], n[keep]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
    if values is None and small is not None:
        own = window[at]
        window[at] = np.where(own < len(small), small[np.minimum(own, len(small) - 1)], own)
    elif values is None:
        window[at] |= 0x20
    else:
        window[at] = np.repeat(values[keep], n) if isinstance(values, np.ndarray) else values


# -- B+ tree of names ------------------------------------------------------------
def build_tree(names: np.ndarray, numbers: np.ndarray) -> bytes:
    """Names, as byte strings of one width, to numbers, in nodes of TREE_FANOUT, leaves first;
    all links are relative."""
    order = np.argsort(names, kind="stable")
    width = names.dtype.itemsize
    entries = np.zeros(len(names), [("k", names.dtype), ("v", "<u8")])
    entries["k"], entries["v"] = names[order], numbers[order]
    at, leaf, body = 24, 1, []
    while True:
        first = np.arange(0, max(1, len(entries)), TREE_FANOUT)
        nodes = [entries[i : i + TREE_FANOUT] for i in first]
        body += [struct.pack("<BxH", leaf, len(n)) + n.tobytes() for n in nodes]
        places = at + np.cumsum([0, *(4 + n.nbytes for n in nodes)])
        if len(nodes) == 1:
            break
        above = np.zeros(len(nodes), entries.dtype)
        above["k"], above["v"] = entries["k"][first], places[:-1]
        entries, at, leaf = above, int(places[-1]), 0
    return struct.pack("<IIQQ", width, TREE_FANOUT, len(names), at) + b"".join(body)


class Tree:
    """A name tree within a source, read a node at a time."""

    def __init__(self, source, base: int):
        self.source, self.base = source, base
        self.width, self.fanout, self.count, self.root = struct.unpack("<IIQQ", source.read_at(base, 24))
        self.top = self.count  # entries of the root
        while self.top > self.fanout > 1:
            self.top = -(-self.top // self.fanout)

    def _node(self, at: int) -> tuple[bool, list[bytes], np.ndarray]:
        # a node and its header at once: what follows it is at hand then, or near the file's end
        most = 4 + (self.top if at == self.root else self.fanout) * (self.width + 8)
        held = self.source.read_at(self.base + at, min(most, self.source.size - self.base - at))
        leaf, count = struct.unpack_from("<BxH", held)
        if len(held) < 4 + count * (self.width + 8):
            raise ValueError("a node of the name tree is cut short")
        raw = np.frombuffer(held, [("k", f"S{self.width}"), ("v", "<u8")], count, 4)
        return bool(leaf), raw["k"].tolist(), raw["v"]

    def find(self, name: str) -> int | None:
        key = name.encode("utf-8")
        if len(key) > self.width:
            return None
        at = self.root
        while True:
            leaf, keys, values = self._node(at)
            i = int(np.searchsorted(np.array(keys, object), key, side="right")) - 1 if keys else -1
            if i < 0 or leaf:
                return int(values[i]) if i >= 0 and keys[i] == key else None
            at = int(values[i])

    def find_all(self, name: str) -> list[int]:
        """All numbers of a name, in the tree's order: along one path, and on to the next
        leaves where a leaf's end doesn't settle it."""
        key = name.encode("utf-8")
        out: list[int] = []
        stack = [self.root] if len(key) <= self.width else []
        while stack:
            leaf, keys, values = self._node(stack.pop())
            low, high = bisect_left(keys, key), bisect_right(keys, key)
            if leaf:
                out += values[low:high].tolist()
            else:  # the first may begin in the child before it
                stack += values[max(0, low - 1) : high][::-1].tolist()
        return out

    def items(self) -> list[tuple[str, int]]:
        """All names with their numbers, in name order."""
        out: list[tuple[str, int]] = []
        stack = [self.root]
        while stack:
            leaf, keys, values = self._node(stack.pop())
            if leaf:
                out += [(k.decode("utf-8", "replace"), int(v)) for k, v in zip(keys, values, strict=True)]
            else:
                stack += [int(v) for v in values[::-1]]
        return out
