"""BPE encoding and decoding by a contiguous rank array.

A short word's parts are kept as a row of boundaries beside a row of ranks, one
rank for each pair of neighbours. The smallest rank is searched again and again,
its boundary is deleted and the ranks at both sides are looked up anew. The
search costs the square of a word's length, so words of over ``SCAN_LIMIT``
symbols are merged through a heap; the ids are the same.

The tokenizer file (JSON of the ``tokenizers`` library: NFC, lower case,
word-end BPE over bytes) is read once on the driver and goes to the executors in
the task's closure; its size is checked.

Letters, numbers and lower case are the tokenizers library's for every code point: those
of Python's own Unicode tables and the additions below, whatever the ``regex`` module has.

Defined results: null text counts as empty; an empty text has no ids and decodes
to an empty text; repeated rows give repeated results; input columns other than
the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from genoframe.llm.rows import by_place

SCAN_LIMIT = 48
#: A worker keeps the ids of so many new words, and of as many older ones.
CACHE_WORDS = 150_000
MAX_FILE_BYTES = 64 << 20
NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


# Fixed values of the Unicode standard, as hexadecimal code points: letters and numbers new
# in version 16, and upper case new in versions 16 and 17 with its lower case.
NEW_CLASSES = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
NEW_LOWER = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def code_range(text: str) -> range:
    low, _, high = text.partition("-")
    return range(int(low, 16), int(high or low, 16) + 1)


NEWER = {c: int(to, 16) + i for upper, to in (x.split(":") for x in NEW_LOWER.split()) for i, c in enumerate(code_range(upper))}


@lru_cache
def held_by(major: str) -> np.ndarray:
    """Whether each code point is in the general categories of a first letter."""
    held = np.array([unicodedata.category(chr(c))[0] == major for c in range(sys.maxunicode + 1)])
    for part in NEW_CLASSES.get(major, "").split():
        held[list(code_range(part))] = True
    return held


@lru_cache
def odd_points() -> np.ndarray:
    """Whether the ``regex`` module or Python's lower case differs for a code point."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    odd = np.zeros(len(every), bool)
    for major in "LN":
        theirs = np.zeros(len(every), bool)
        for m in regex.finditer(rf"\p{{{major}}}+", every):
            theirs[m.start() : m.end()] = True
        odd |= theirs != held_by(major)
    odd[list(NEWER)] = True
    return odd


@lru_cache
def code_points(major: str, below: int) -> str:
    """The code points of a general category's first letter, as ranges of a character class."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held_by(major)[:below].astype(np.int8), [0]]))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


#: Code points below this one are Latin, and none of them is odd.
NEAR = 0x180


def by_ranges(pattern: str, below: int = sys.maxunicode + 1) -> str:
    """A pattern with ranges for its letters and numbers."""
    for major in "LN":
        points = code_points(major, below)
        pattern = re.sub(rf"(\[[^]]*)\\p\{{{major}\}}", lambda m: m.group(1) + points, pattern).replace(rf"\p{{{major}}}", f"[{points}]")  # noqa: B023
    return pattern


class WordBpe:
    """Encoder and decoder of a word-end BPE file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        #: ranks of an id's pairs, by its right neighbour; id of a rank's result
        self.ranks: list[dict[int, int]] = [{}] * (1 + max(vocab.values()))
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            of_left = vocab[left]
            self.ranks[of_left] = self.ranks[of_left] or {}
            self.ranks[of_left][vocab[right]] = rank
            self.made.append(vocab[left + right])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.added_starts = {t[0] for t in added if t}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Unicode's White_Space only: Python's \s also has the separators 1C to 1F
        space = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = split["pattern"]["Regex"].replace(r"[^\s", "[^" + space)
        self.words = regex.compile(pattern).findall
        # texts of Latin letters only are cut by the plainer module, whose classes are short here
        self.near_words = re.compile(by_ranges(pattern, NEAR).replace(space, r"\x09-\x0d\x20\x85\xa0")).findall
        # a class of many ranges is slow, so it is for texts only that have odd code points
        pattern = by_ranges(pattern)
        self.odd, self.odd_words = odd_points(), regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- merging one word ---------------------------------------------------
    def start(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        return ids

    def scan(self, ids: list[int]) -> list[int]:
        """Contiguous rank array: for short words."""
        ranks, made = self.ranks, self.made
        found = [ranks[a].get(b, NO_RANK) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while found and (best := min(found)) != NO_RANK:
            at = found.index(best)
            new = ids[at] = made[best]
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = ranks[ids[at - 1]].get(new, NO_RANK)
            if at < len(found):
                found[at] = ranks[new].get(ids[at + 1], NO_RANK)
        return ids

    def heaped(self, ids: list[int]) -> list[int]:
        """The same merges in n log n, for long words."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks[a].get(b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            new, ids[j] = self.made[rank], -1
            ids[i], after[i] = new, after[j]
            k, h = after[i], before[i]
            if k >= 0:
                before[k] = i
                if (r := ranks[new].get(ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if h >= 0 and (r := ranks[ids[h]].get(new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        ids = self.start(word)
        return self.scan(ids) if len(ids) <= SCAN_LIMIT else self.heaped(ids)

    # -- whole texts --------------------------------------------------------
    def _plain(self, text: str) -> bytes:
        find = self.near_words
        if not text.isascii():
            # each character is lower-cased by itself, so a final sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            # a letter that has two characters in lower case passes the border
            if points.max(initial=0) >= NEAR or "İ" in text:
                find = self.words
                if self.odd[points].any():
                    find, text = self.odd_words, text.translate(NEWER)
        words = find(text.lower())
        cache = self.cache
        if new := set(words).difference(cache):
            if len(cache) > CACHE_WORDS:
                self.older, self.cache = cache, {}
                cache, new = self.cache, set(words)
            older = self.older.get
            for w in new:
                cache[w] = older(w) or array("i", self.word(w)).tobytes()
        return b"".join([cache[w] for w in words])

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as int32 in the machine's byte order."""
        if not text:
            return b""
        if not any(c in text for c in self.added_starts):
            return self._plain(text)
        parts = self.split_added.split(text)
        return b"".join(np.int32(self.added[p]).tobytes() if p in self.added else self._plain(p) for p in parts if p)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def read_spec(path: str) -> str:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: a tokenizer file of over {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[int, WordBpe] = {}


def _tokenizer(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(json.loads(spec))
    return _loaded[key]


def bpe_encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """``key``, ``ids array<int>`` and, with ``decode``, the ``decoded string`` of every row.

    One pass over the rows without a shuffle. A text is tokenized whole.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = [bpe.encode_bytes(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decode:
                    columns.append(pa.array([bpe.decode(np.frombuffer(c, dtype=np.int32).tolist()) for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decode)


def bpe_decode(coded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``decoded`` text of each row's ids; null ids count as none."""
    spec = coded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    return coded.select(F.col(key), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, decoded string")


#: What ``with_tokens`` adds.
TOKEN_COLUMNS = ("n_tokens", "ids", "decoded_sha256")


def with_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """All columns of every row, with ``n_tokens long``, ``ids array<int>`` and the SHA-256
    of the decoded text. Input columns named like one of these, in any case, are left out."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    left = [i for i, c in enumerate(docs.columns) if c.lower() not in TOKEN_COLUMNS]
    kept = by_place(docs).select([f"c{i}" for i in left])
    at_text = left.index(docs.columns.index(text))
    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = [np.frombuffer(bpe.encode_bytes(None if t is None else str(t)), dtype=np.int32) for t in part.column(at_text).to_pylist()]
                sizes = np.array([len(c) for c in coded], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([*coded, np.zeros(0, np.int32)])
                sums = [hashlib.sha256(bpe.decode(c.tolist()).encode("utf-8")).hexdigest() for c in coded]
                columns = [pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sums, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *TOKEN_COLUMNS])

    return kept.mapInArrow(run, schema).toDF(*(docs.columns[i] for i in left), *TOKEN_COLUMNS)
