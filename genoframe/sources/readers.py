"""Random access to containers: names, lookups and decoded windows.

Readers are what a task opens. They read headers, tables and packed bases by position
and decode a window without touching the rest of its sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from genoframe.operators.runs import MASK_RUN, N_RUN
from genoframe.sources import codec as C
from genoframe.sources.ranged import beside, is_url, open_source, read_beside

#: Bytes of a table of contents that are read at once.
TOC_CHUNK = 8 << 20
#: Bytes that are read at once in search of headers that stand between bases.
HEADERS = 1 << 13
#: Block tables up to which a table is read whole; larger ones are searched by halves.
WHOLE_TABLE = 4096


def window_of(start: int, end: int | None, size: int) -> tuple[int, int]:
    end = size if end is None else min(end, size)
    return min(start, end), end


def ranks(marks: list[int], among) -> list[int]:
    """How many of some numbers are below each mark."""
    return np.searchsorted(np.sort(np.array(among, np.int64)), np.array(marks, np.int64)).tolist()


class Reader:
    kind = ""

    def __init__(self, source):
        self.source = source

    def toc(self) -> list[tuple[str, int]]:
        """Names and places of all sequences, in file order."""
        raise NotImplementedError

    def extract_at(self, place: int, start: int = 0, end: int | None = None) -> str:
        raise NotImplementedError

    def length_at(self, place: int) -> int:
        raise NotImplementedError

    @cached_property
    def _by_name(self) -> dict[str, int]:
        return dict(self.toc())  # of equal names the last

    def find(self, name: str) -> int | None:
        return self._by_name.get(name)

    #: Whether names are found without the table of contents.
    indexed = False

    def find_all(self, name: str) -> list[tuple[int, int]]:
        """Of an indexed file, places of all sequences of a name, with what ``ordinals_of`` takes."""
        raise NotImplementedError

    def ordinals_of(self, marks: list[int]) -> list[int]:
        """How many sequences stand before each of some, by their marks."""
        raise NotImplementedError

    def names(self) -> list[str]:
        return [n for n, _ in self.toc()]

    def infos(self) -> list[tuple[str, int]]:
        return [(n, self.length_at(p)) for n, p in self.toc()]

    def extract(self, name: str, start: int = 0, end: int | None = None) -> str:
        place = self.find(name)
        if place is None:
            raise KeyError(f'no sequence named "{name}"')
        return self.extract_at(place, start, end)

    def http_stats(self) -> tuple[int, int]:
        return self.source.requests, self.source.fetched

    def _u32(self, at: int) -> int:
        return struct.unpack(self.order + "I", self.source.read_at(at, 4))[0]

    def _u32s(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(at, 4 * n), self.order + "u4").astype(np.int64)

    order = "<"


class TwoBitReader(Reader):
    kind = "twobit"

    def __init__(self, source):
        super().__init__(source)
        if source.size < 16:
            raise ValueError("not a 2-bit file: under 16 bytes")
        head = source.read_at(0, 16)
        self.order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == C.TWOBIT_MAGIC), "")
        if not self.order:
            raise ValueError("not a 2-bit file: bad signature")
        version, self.count = struct.unpack(self.order + "II", head[4:12])
        if version > 1:
            raise ValueError(f"2-bit version {version} is unknown")
        self.long = version == 1
        self.iub, self.index, self.index_at = False, "none", 0
        tail = source.read_at(source.size - 24, 24) if source.size >= 40 else b""
        if tail[20:] in (C.PTR_FOOTER, C.BPT_FOOTER):
            self.index_at, _, flags = struct.unpack("<QQI", tail[:20])
            self.index = "ptr" if tail[20:] == C.PTR_FOOTER else "bpt"
            self.iub = bool(flags & 1)
        elif source.size >= 24 and source.read_at(source.size - 8, 4) == C.IUB_TRAILER:
            self.iub = True

    def _entry(self, at: int) -> tuple[str, int, int]:
        """Name, place and end of a table-of-contents entry."""
        return next(self._entries(at, 1, 1 + 255 + 8))

    def _entries(self, at: int, count: int, chunk: int = TOC_CHUNK) -> Iterator[tuple[str, int, int]]:
        """Entries that follow one another, read a chunk at a time."""
        width, kind = (8, "Q") if self.long else (4, "I")
        held, i, first = b"", 0, 0
        for k in range(count):
            if i >= len(held) or i + 1 + held[i] + width > len(held):
                at, i = at + i, 0
                # records mostly begin where the table ends, and the first entry says where
                most = 264 if not k else max(264, min(chunk, first - at)) if first > at else chunk
                held = self.source.read_at(at, min(most, self.source.size - at))
                if not held or 1 + held[0] + width > len(held):
                    raise ValueError("the table of contents is cut short")
            end = i + 1 + held[i]
            place = struct.unpack_from(self.order + kind, held, end)[0]
            first = first or place
            yield held[i + 1 : end].decode("utf-8", "replace"), place, at + end + width
            i = end + width

    @cached_property
    def _toc(self) -> list[tuple[str, int]]:
        return [(name, place) for name, place, _ in self._entries(16, self.count)]

    def toc(self):
        return self._toc

    def find(self, name):
        if self.index == "bpt":
            return C.Tree(self.source, self.index_at).find(name)
        if self.index == "ptr" and "_by_name" not in self.__dict__:
            found = self._pointed(name, any_=True)
            return found[0][0] if found else None
        return super().find(name)

    indexed = property(lambda self: self.index != "none")

    def _pointed(self, name: str, any_: bool = False) -> list[tuple[int, int]]:
        """Places and entries of a name by the sorted pointers: a search by halves for the
        first of them and its equals behind it, or for any one."""
        key = name.encode("utf-8")

        def entry(i: int) -> tuple[bytes, int, int]:
            at = struct.unpack("<Q", self.source.read_at(self.index_at + 8 * i, 8))[0]
            found, place, _ = self._entry(at)
            return found.encode("utf-8"), place, at

        low, high = 0, self.count
        while low < high:
            mid = (low + high) // 2
            own, *hit = entry(mid)
            if any_ and own == key:
                return [(hit[0], hit[1])]
            low, high = (mid + 1, high) if own < key else (low, mid)
        out = []
        for i in range(low, low if any_ else self.count):
            own, *hit = entry(i)
            if own != key:
                break
            out.append((hit[0], hit[1]))
        return out

    def find_all(self, name):
        if self.index == "bpt":
            return [(place, place) for place in C.Tree(self.source, self.index_at).find_all(name)]
        return self._pointed(name)

    def ordinals_of(self, marks):
        if self.index == "bpt":
            return ranks(marks, [place for _, place in C.Tree(self.source, self.index_at).items()])
        return ranks(marks, np.frombuffer(self.source.read_at(self.index_at, 8 * self.count), "<u8"))

    def length_at(self, place):
        return self._u32(place)

    def _blocks(self, at: int, s: int, e: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """First block, number and tables of the blocks at ``at`` that meet [s, e)."""
        count = self._u32(at)
        low, high = 0, count
        if count > WHOLE_TABLE:
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self._u32(at + 4 + 4 * mid) <= s else (low, mid)
            low = max(0, low - 1)
            high = low
            while high < count and self._u32(at + 4 + 4 * min(count - 1, high + 1024)) < e and high + 1024 < count:
                high += 1024
            high = min(count, high + 1025)
        starts, sizes = self._u32s(at + 4 + 4 * low, high - low), self._u32s(at + 4 + 4 * (count + low), high - low)
        meet = (starts < e) & (starts + sizes > s)
        return low, count, np.where(meet, starts, -1), sizes

    def _lay(self, window, start, at, size, value, codes_at=None):
        low, _, starts, sizes = self._blocks(at, start, start + len(window))
        if (starts + sizes > size).any():
            raise ValueError("a block reaches over the end of its sequence")
        keep = starts >= 0
        if codes_at is not None:
            value = np.frombuffer(self.source.read_at(codes_at + low, len(starts)), np.uint8)[keep]
        C.lay(window, start, starts[keep], sizes[keep], value)

    def extract_at(self, place, start=0, end=None):
        size = self._u32(place)
        s, e = window_of(start, end, size)
        if s >= e:
            return ""
        n_at = place + 4
        m_at = n_at + 4 + 8 * self._u32(n_at)
        packed = m_at + 4 + 8 * self._u32(m_at) + 4
        low = s // 4
        window = C.unpack2(self.source.read_at(packed + low, -(-e // 4) - low), s % 4, e - s)
        self._lay(window, s, n_at, size, ord("N"))
        if self.iub:
            i_at = packed + -(-size // 4)
            self._lay(window, s, i_at, size, 0, codes_at=i_at + 4 + 8 * self._u32(i_at))
        self._lay(window, s, m_at, size, None)
        return window.tobytes().decode("latin-1")


class FourBitReader(Reader):
    kind = "fourbit"

    def __init__(self, source):
        super().__init__(source)
        head = source.read_at(0, 16) if source.size >= 16 else b""
        if head[:4] != C.FOURBIT_MAGIC:
            raise ValueError("not a 4-bit file")
        version, self.count = struct.unpack("<II", head[4:12])
        if version != 1:
            raise ValueError(f"4-bit version {version} is unknown")

    @cached_property
    def _toc(self):
        # headers stand between bases: what is near the last one is read with it
        out, at, held, begin = [], 16, b"", 0
        for _ in range(self.count):
            if not begin <= at <= begin + len(held) - 264:
                begin, held = at, self.source.read_at(at, min(HEADERS, self.source.size - at))
            i = at - begin
            if len(held) < i + 9 or len(held) < i + 9 + held[i]:
                raise ValueError("the last header is cut short")
            n = held[i]
            out.append((held[i + 1 : i + 1 + n].decode("utf-8", "replace"), at + 1 + n))
            at += 9 + n + (struct.unpack_from("<Q", held, i + 1 + n)[0] + 1) // 2
        return out

    def toc(self):
        return self._toc

    def length_at(self, place):
        return struct.unpack("<Q", self.source.read_at(place, 8))[0]

    def extract_at(self, place, start=0, end=None):
        s, e = window_of(start, end, self.length_at(place))
        if s >= e:
            return ""
        raw = self.source.read_at(place + 8 + s // 2, -(-e // 2) - s // 2)
        return C.unpack4(raw, s % 2, e - s).tobytes().decode("latin-1")


class TwoBeReader(Reader):
    kind = "twobe"

    def __init__(self, source):
        super().__init__(source)
        head = source.read_at(0, 32) if source.size >= 32 else b""
        if head[:4] != C.TWOBE_MAGIC:
            raise ValueError("not a 2be file")
        self.count, toc = struct.unpack("<QQ", head[8:24])
        if toc + 24 > source.size:
            raise ValueError("the table of contents is past the end")
        self.tree = C.Tree(source, toc)

    @cached_property
    def _toc(self):
        """In name order, as the tree has it; places give the file's order."""
        return self.tree.items()

    def toc(self):
        return self._toc

    def find(self, name):
        return self.tree.find(name)

    indexed = True

    def find_all(self, name):
        return [(place, place) for place in self.tree.find_all(name)]

    def ordinals_of(self, marks):
        return ranks(marks, [place for _, place in self.toc()])

    def length_at(self, place):
        return self._u32(place)

    def edits_at(self, place: int) -> int:
        return self._u32(place + 4)

    def extract_at(self, place, start=0, end=None):
        size, count = (int(x) for x in self._u32s(place, 2))
        s, e = window_of(start, end, size)
        if s >= e:
            return ""
        first = place + 8
        runs = first + 10 * count
        n_runs = self._u32(runs)
        packed = runs + 4 + 4 * n_runs
        window = C.unpack2(self.source.read_at(packed + s // 4, -(-e // 4) - s // 4), s % 4, e - s)

        def lower(x: int) -> int:
            """The first edit at or after a place."""
            low, high = 0, count
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self._u32(first + 10 * mid) < x else (low, mid)
            return low

        a, b = lower(s), lower(e)
        near = np.frombuffer(self.source.read_at(first + 10 * a, 10 * (b - a)), C.EDIT)
        # runs that began before the window, by the index of those that aren't points
        index = self._u32s(runs + 4, n_runs)
        index = index[index < a]
        if len(index) and len(index) * 4 < a:
            before = np.concatenate([np.frombuffer(self.source.read_at(first + 10 * int(i), 10), C.EDIT) for i in index])
        else:
            before = np.frombuffer(self.source.read_at(first, 10 * a), C.EDIT)[index] if len(index) else near[:0]
        edits = np.concatenate([before[before["pos"].astype(np.int64) + before["len"] > s], near])
        for own in (edits[edits["etype"] < MASK_RUN], edits[edits["etype"] == MASK_RUN]):
            if (own["pos"].astype(np.int64) + own["len"] > size).any():
                raise ValueError("an edit reaches over the end of its sequence")
            mask = len(own) and own["etype"][0] == MASK_RUN
            values = None if mask else np.where(own["etype"] == N_RUN, ord("N"), own["code"]).astype(np.uint8)
            C.lay(window, s, own["pos"].astype(np.int64), own["len"].astype(np.int64), values)
        return window.tobytes().decode("latin-1")


# -- FASTA with an index, plain or BGZF -----------------------------------------
BGZF_MAGIC = b"\x1f\x8b\x08\x04"


def is_bgzf(head: bytes) -> bool:
    return head[:4] == BGZF_MAGIC and head[12:14] == b"BC"


def bgzf_blocks(source) -> list[tuple[int, int, int, int]]:
    """Place and size of every block, compressed and not; empty blocks are passed over."""
    out, at, done = [], 0, 0
    while at < source.size:
        head = source.read_at(at, min(18, source.size - at))
        if len(head) < 18 or not is_bgzf(head):
            raise ValueError(f"no BGZF block at {at}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        if at + size > source.size:
            raise ValueError("a BGZF block is cut short")
        plain = struct.unpack("<I", source.read_at(at + size - 4, 4))[0]
        if plain:
            out.append((at, size, done, plain))
        at, done = at + size, done + plain
    return out


def indexed_starts(source, gzi: bytes) -> np.ndarray:
    """Compressed and plain places of the blocks that a ``.gzi`` index has, as rows."""
    count = struct.unpack("<Q", gzi[:8])[0]
    if len(gzi) < 8 + 16 * count:
        raise ValueError("the block index is cut short")
    return np.concatenate([np.zeros((1, 2), np.int64), np.frombuffer(gzi, "<u8", 2 * count, 8).astype(np.int64).reshape(-1, 2)])


def block_rows(source, gzi: bytes) -> np.ndarray:
    """As ``bgzf_blocks``, by a ``.gzi`` index, as rows of numbers; only the last block's header
    is read."""
    starts = indexed_starts(source, gzi)
    whole = np.diff(starts, axis=0)
    c, u = (int(x) for x in starts[-1])
    last = [(c + a, size, u + b, plain) for a, size, b, plain in bgzf_blocks(_Tail(source, c))]
    return np.concatenate([np.stack([starts[:-1, 0], whole[:, 0], starts[:-1, 1], whole[:, 1]], axis=1), np.array(last, np.int64).reshape(-1, 4)])


def indexed_blocks(source, gzi: bytes) -> list[tuple[int, int, int, int]]:
    return [tuple(row) for row in block_rows(source, gzi).tolist()]


class _Tail:
    """A source from a place on."""

    def __init__(self, source, at: int):
        self.source, self.at, self.size = source, at, source.size - at

    def read_at(self, offset: int, n: int) -> bytes:
        return self.source.read_at(self.at + offset, n)


def inflate_block(block: bytes) -> bytes:
    plain = zlib.decompress(block[18:-8], -15)
    crc, size = struct.unpack("<II", block[-8:])
    if len(plain) != size or zlib.crc32(plain) != crc:
        raise ValueError("a BGZF block does not match its checksum")
    return plain


class _Inflated:
    """A BGZF source as the bytes that it holds; the block that was read last is kept."""

    def __init__(self, source, gzi: bytes | None = None):
        self.under = source
        self.rows = np.array(bgzf_blocks(source), np.int64).reshape(-1, 4) if gzi is None else block_rows(source, gzi)
        self.starts = self.rows[:, 2]
        self.size = int(self.rows[-1, 2:].sum()) if len(self.rows) else 0
        self.kept, self.plain = -1, b""

    blocks = property(lambda self: [tuple(row) for row in self.rows.tolist()])
    requests = property(lambda self: self.under.requests)
    fetched = property(lambda self: self.under.fetched)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.size:
            raise ValueError("read past the end")
        out, i = [], int(np.searchsorted(self.starts, offset, side="right")) - 1
        while n > 0:
            c, size, u, _ = self.rows[i].tolist()
            if i != self.kept:
                self.kept, self.plain = i, inflate_block(self.under.read_at(c, size))
            part = self.plain[offset - u :][:n]
            out.append(part)
            offset, n, i = offset + len(part), n - len(part), i + 1
        return b"".join(out)


def parse_fai(text: str) -> list[tuple[str, int, int, int, int]]:
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        if line.strip():
            fields = line.split("\t")
            if len(fields) < 5 or not all(f.strip().isdigit() for f in fields[1:5]):
                raise ValueError(f"line {i} of the index does not have a name and four numbers")
            out.append((fields[0], *(int(f) for f in fields[1:5])))
    return out


def scan_fai(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """The index of a FASTA text. Carriage returns are not counted as bases."""
    out: list[list] = []
    at = 0
    # bytes.split, not splitlines: a lone carriage return ends no line
    lines = data.split(b"\n")
    for raw in [*(x + b"\n" for x in lines[:-1]), *filter(None, lines[-1:])]:
        body = raw.rstrip(b"\r\n")
        if body.startswith(b">"):
            words = body[1:].split()
            out.append([words[0].decode("utf-8", "replace") if words else "", 0, at + len(raw), 0, 0])
        elif out:
            if not out[-1][3]:
                out[-1][3:] = len(body), len(raw)
            out[-1][1] += len(body)
        at += len(raw)
    return [tuple(r) for r in out]


class FaidxReader(Reader):
    kind = "faidx"

    def __init__(self, source, fai: list[tuple[str, int, int, int, int]] | None = None, gzi: bytes | None = None):
        self.bgzf = is_bgzf(source.read_at(0, min(18, source.size)))
        super().__init__(source)
        self.gzi = gzi
        self.given = fai
        self.index_requests = (0, 0)

    @cached_property
    def text(self):
        return _Inflated(self.source, self.gzi) if self.bgzf else self.source

    @cached_property
    def fai(self) -> list[tuple[str, int, int, int, int]]:
        return self.given if self.given is not None else scan_fai(self.text.read_at(0, self.text.size))

    def toc(self):
        return [(r[0], i) for i, r in enumerate(self.fai)]

    def length_at(self, place):
        return self.fai[place][1]

    def http_stats(self):
        return tuple(a + b for a, b in zip(super().http_stats(), self.index_requests, strict=True))

    def extract_at(self, place, start=0, end=None):
        _, size, offset, bases, width = self.fai[place]
        s, e = window_of(start, end, size)
        if s >= e:
            return ""
        per = max(bases, 1)
        first, last = (offset + p // per * width + p % per for p in (s, e - 1))
        return self.text.read_at(first, last + 1 - first).translate(None, b"\r\n").decode("latin-1")


def detect(head: bytes) -> str:
    """The format of a file by its first 64 bytes or fewer."""
    if head[:4] in (struct.pack("<I", C.TWOBIT_MAGIC), struct.pack(">I", C.TWOBIT_MAGIC)):
        return "twobit"
    if head[:4] == C.TWOBE_MAGIC:
        return "twobe"
    if head[:4] == C.FOURBIT_MAGIC:
        return "fourbit"
    if is_bgzf(head):
        return "bgzf"
    if head.lstrip(b" \t\r\n\f")[:1] == b">":
        return "fasta"
    raise ValueError("unknown format")


def open_reader(path: str, lines: tuple[int, int] | None = None) -> Reader:
    """A reader for a local path, a store's URI or a URL. A FASTA file without an index is
    scanned; with ``lines``, only these bytes of its index are read."""
    source = open_source(path)
    kind = detect(source.read_at(0, min(64, source.size)))
    if kind in ("bgzf", "fasta"):
        fai, gzi, used = None, None, (0, 0)
        if is_url(path):
            side = open_source(beside(path, ".fai"))
            fai = parse_fai(side.read_at(0, side.size).decode("utf-8", "replace"))
            used = side.requests, side.fetched
        else:
            text, gzi = read_beside(path, ".fai", lines), read_beside(path, ".gzi")
            fai = None if text is None else parse_fai(text.decode("utf-8", "replace"))
        reader = FaidxReader(source, fai, gzi)
        reader.index_requests = used
        return reader
    return {"twobit": TwoBitReader, "twobe": TwoBeReader, "fourbit": FourBitReader}[kind](source)
