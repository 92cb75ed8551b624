"""Container records a sequence at a time: what the batch encoders are compared with."""

from __future__ import annotations

import struct

import numpy as np

from genoframe.operators.runs import IUB_POINT, IUB_RUN, MASK_RUN, N_RUN
from genoframe.sources.codec import CODE, EDIT, LOWER, PLAIN, TO_NIBBLE, TO_TWO, TREE_FANOUT, as_bytes


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and values of the maximal runs of equal values that are not 0."""
    if not len(values):
        return (np.zeros(0, np.int64),) * 3
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    own = values[starts]
    keep = own != 0
    return starts[keep], sizes[keep], own[keep]


def pack2(a: np.ndarray) -> bytes:
    d = np.zeros(-(-len(a) // 4) * 4, np.uint8)
    d[: len(a)] = TO_TWO[a]
    d = d.reshape(-1, 4)
    return (d[:, 0] << 6 | d[:, 1] << 4 | d[:, 2] << 2 | d[:, 3]).astype(np.uint8).tobytes()


def pack4(a: np.ndarray) -> bytes:
    d = np.zeros(-(-len(a) // 2) * 2, np.uint8)
    d[: len(a)] = TO_NIBBLE[a]
    return (d[0::2] << 4 | d[1::2]).astype(np.uint8).tobytes()


def _limit(n: int) -> None:
    if n > 2**32 - 1:
        raise ValueError(f"a sequence of {n} bases is over the format's 2^32-1")


def check_name(name: str) -> bytes:
    raw = name.encode("utf-8")
    if len(raw) > 255:
        raise ValueError(f"a name of {len(raw)} bytes is over the format's 255")
    return raw


def twobit_record(bases: str | bytes, iub: bool) -> bytes:
    a = as_bytes(bases)
    _limit(len(a))
    n, mask = runs_of((~PLAIN[a]).astype(np.uint8))[:2], runs_of(LOWER[a].astype(np.uint8))[:2]
    parts = [struct.pack("<I", len(a))]
    for starts, sizes in (n, mask):
        parts += [struct.pack("<I", len(starts)), starts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
    parts += [struct.pack("<I", 0), pack2(a)]
    if iub:
        starts, sizes, codes = runs_of(CODE[a])
        parts += [struct.pack("<I", len(starts)), starts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), codes.astype(np.uint8).tobytes()]
    return b"".join(parts)


def edits_of(a: np.ndarray) -> np.ndarray:
    """The merged edit stream, ordered by place and type."""
    base = np.where(PLAIN[a], 0, np.where(CODE[a] > 0, CODE[a], ord("N"))).astype(np.uint8)
    starts, sizes, codes = runs_of(base)
    m_starts, m_sizes, _ = runs_of(LOWER[a].astype(np.uint8))
    out = np.zeros(len(starts) + len(m_starts), EDIT)
    k = len(starts)
    out["pos"][:k], out["len"][:k] = starts, sizes
    out["etype"][:k] = np.where(codes == ord("N"), N_RUN, np.where(sizes == 1, IUB_POINT, IUB_RUN))
    out["code"][:k] = np.where(codes == ord("N"), 0, codes)
    out["pos"][k:], out["len"][k:], out["etype"][k:] = m_starts, m_sizes, MASK_RUN
    return out[np.lexsort((out["etype"], out["pos"]))]


def twobe_record(bases: str | bytes) -> bytes:
    a = as_bytes(bases)
    _limit(len(a))
    edits = edits_of(a)
    index = np.flatnonzero(edits["etype"] != IUB_POINT).astype("<u4")
    return b"".join([struct.pack("<II", len(a), len(edits)), edits.tobytes(), struct.pack("<I", len(index)), index.tobytes(), pack2(a)])


def fourbit_record(name: str, bases: str | bytes) -> bytes:
    raw, a = check_name(name), as_bytes(bases)
    return bytes([len(raw)]) + raw + struct.pack("<Q", len(a)) + pack4(a)


def build_tree(items: list[tuple[bytes, int]]) -> bytes:
    """Names to numbers, in nodes of TREE_FANOUT, leaves first; all links are relative."""
    items = sorted(items)
    width = max([1, *(len(k) for k, _ in items)])
    entry = struct.Struct(f"<{width}sQ")
    at = 24
    body: list[bytes] = []
    level = [(items[i][0] if items else b"", 1, items[i : i + TREE_FANOUT]) for i in range(0, max(1, len(items)), TREE_FANOUT)]
    while True:
        above = []
        for first, leaf, entries in level:
            node = struct.pack("<BxH", leaf, len(entries)) + b"".join(entry.pack(k, v) for k, v in entries)
            above.append((first, at))
            body.append(node)
            at += len(node)
        if len(above) == 1:
            break
        level = [(above[i][0], 0, above[i : i + TREE_FANOUT]) for i in range(0, len(above), TREE_FANOUT)]
    return struct.pack("<IIQQ", width, TREE_FANOUT, len(items), above[0][1]) + b"".join(body)
