"""Documents that hold passages of a benchmark.

Every window of an item's length is summed up in a 64-bit SimHash of its five-word
shingles, each weighted by how often the window has it. Fingerprints are searched
by multi-index hashing: of BLOCKS blocks, two fingerprints that differ in up to
RADIUS bits have one that differs in NEAR bits or fewer, so looking every block up
among its neighbours misses none within the radius. Candidates are verified by
their weighted Jaccard similarity, the sum of the smaller counts over the sum of
the larger ones, on exact counts.

Windows that share no shingle with any item of their length can't be similar, so
only those that share one are fingerprinted; texts are scanned whole for shared
shingles. The similarity at which pairs are kept lies at an expected distance of
under 10 bits, RADIUS is over four standard deviations above it.

The items' index goes to the executors in slices of SLICE_BYTES of text or so. Where
there are several, they are taken one after another, each with a pass over the documents
whose result is written before the next slice is read, so neither the driver nor an
executor holds more than one.

Defined results: an item of under five words is one shingle of its own length; a
document shorter than an item is compared as a whole; null or empty items and
documents match nothing; of an item's windows in a document the most similar, then
the first, is reported; repeated rows are reported each; columns that are not named
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.rows import keep_rows
from genoframe.llm.scratch import Scratch
from genoframe.llm.shingles import WORDS, gram_sequence, word_hashes, words_of

SIMILARITY = 0.8
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
SLICE_BYTES = 64 << 20
#: Pairs of windows and items that are looked up together.
TOGETHER = 1 << 21

_bytes = np.arange(256, dtype=np.uint8)
#: What a block's value is combined with to get all values that differ in NEAR bits or fewer.
NEIGHBOURS = _bytes[np.bitwise_count(_bytes) <= NEAR]


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 numbers, 1 or -1, for each hash."""
    return np.unpackbits(hashes[:, None].view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each run of ``width`` grams, as eight bytes."""
    sums = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits_of(grams), axis=0, out=sums[1:])
    return np.packbits(sums[width:] > sums[:-width], axis=1)


class Items:
    """The items of one length in words: ``grams`` has a row of them for each item.

    For each block, the items are kept in the order of their value in that block, with
    the place where each value begins."""

    def __init__(self, length: int, ids: list[int], grams: np.ndarray):
        self.length, self.ids, self.grams = length, ids, np.sort(grams, axis=1)
        self.k = min(length, WORDS)
        self.known = np.unique(grams)
        self.prints = np.concatenate([fingerprints(g, len(g)) for g in grams])
        self.lists = np.argsort(self.prints, axis=0, kind="stable").T.astype(np.int32)
        self.begins = np.array([np.searchsorted(self.prints[row, b], np.arange(257)) for b, row in enumerate(self.lists)])

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint and an item that have blocks within NEAR bits."""
        n = len(self.ids)
        found = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            values = (prints[:, b, None] ^ NEIGHBOURS[None, :]).astype(np.int64)
            low, size = self.begins[b][values], self.begins[b][values + 1] - self.begins[b][values]
            of = np.repeat(np.arange(len(prints)), size.sum(1))
            flat = size.ravel()
            at = np.arange(len(of)) - np.repeat(np.cumsum(flat) - flat, flat) + np.repeat(low.ravel(), flat)
            found.append(of * n + self.lists[b][at])
        return np.divmod(np.unique(np.concatenate(found)), n)

    def search(self, grams: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Similarity, first gram and distance of the best window for each item found."""
        width = min(self.length - self.k + 1, len(grams))
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        shared = np.concatenate([[0], np.cumsum(self.known[at] == grams)])
        starts = np.flatnonzero(shared[width:] > shared[:-width])
        best: dict[int, tuple[float, int, int]] = {}
        together = max(1, min(4096, TOGETHER // len(self.ids)))
        for i in range(0, len(starts), together):
            some = starts[i : i + together]
            # windows that stand far apart are fingerprinted apart
            for near in np.split(some, np.flatnonzero(np.diff(some) > 4 * width + 1024) + 1):
                low = int(near[0])
                prints = fingerprints(grams[low : int(near[-1]) + width], width)[near - low]
                w, item = self.lookup(prints)
                far = np.bitwise_count(prints[w] ^ self.prints[item]).sum(1)
                for j in np.flatnonzero(far <= RADIUS):
                    window, one = int(near[w[j]]), int(item[j])
                    s = self.similarity(grams[window : window + width], one)
                    if s >= SIMILARITY and s > best.get(one, (0.0,))[0]:
                        best[one] = s, window, int(far[j])
        return best

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Smaller counts over larger ones, of the grams of a window and of an item."""
        theirs = self.grams[item]
        own, n = np.unique(window, return_counts=True)
        has = np.searchsorted(theirs, own, side="right") - np.searchsorted(theirs, own)
        both = int(np.minimum(n, has).sum())
        return both / (len(window) + len(theirs) - both)


def index_items(rows: list[tuple[int, str | None]]) -> list[Items]:
    """The index of (id, text) items, by length."""
    found: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for one, text in rows:
        h = word_hashes(words_of(text))
        if len(h):
            ids, grams = found.setdefault(len(h), ([], []))
            ids.append(one)
            grams.append(gram_sequence(h, min(len(h), WORDS)))
    return [Items(n, ids, np.array(grams)) for n, (ids, grams) in sorted(found.items())]


def matches(text: str | None, index: list[Items], known: dict[int, np.ndarray]) -> list[tuple[int, float, int, int, int]]:
    """Item, similarity, first word, words and distance of each item that a text holds."""
    h = word_hashes(words_of(text))
    out = []
    for k, all_known in known.items():
        grams = gram_sequence(h, k)
        if not len(grams):
            continue
        at = np.minimum(np.searchsorted(all_known, grams), len(all_known) - 1)
        if not (all_known[at] == grams).any():
            continue
        for items in index:
            if items.k == k:
                for one, (s, first, far) in items.search(grams).items():
                    out.append((items.ids[one], s, first, min(items.length, len(h)), far))
    return sorted(out)


def each_slice(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[object, bool]]:
    """A broadcast index of each slice of the benchmark, and whether it is the only one."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    for number in range(slices):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == number).orderBy("id", "text").collect()
        index = index_items([tuple(r) for r in part])
        known = {k: np.unique(np.concatenate([i.known for i in index if i.k == k])) for k in {i.k for i in index}}
        shared = spark.sparkContext.broadcast((index, known))
        del part, index, known
        yield shared, slices == 1
        if slices > 1:
            shared.destroy()


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, ``item_id``, ``similarity``, ``first_word``, ``n_words`` and ``distance``
    of every benchmark item that a document holds a passage of."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    names = ["item_id", "similarity", "first_word", "n_words", "distance"]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, known = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    found, take = [], []
                    for i, t in enumerate(piece.column(1).to_pylist()):
                        got = matches(t, index, known)
                        found += got
                        take += [i] * len(got)
                    columns = [pa.array([f[j] for f in found], k) for j, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(take, pa.int64())), *columns], names=[key, *names])

        return slim.mapInArrow(run, f"`{key}` {kind}, item_id long, similarity double, first_word int, n_words int, distance int")

    scratch = Scratch(docs.sparkSession)
    return reduce(DataFrame.unionAll, [searched(shared) if only else scratch.table(searched(shared), "passages") for shared, only in each_slice(benchmark, item, item_text)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, as they are, that hold no passage of a benchmark item."""
    given = docs

    def kept(docs: DataFrame, shared) -> DataFrame:
        def decider():
            index, known = shared.value
            return lambda texts: [not matches(t, index, known) for t in texts]

        return keep_rows(docs, text, decider)

    scratch = Scratch(docs.sparkSession)
    for shared, only in each_slice(benchmark, item, item_text):
        before, docs = docs, kept(docs, shared) if only else scratch.table(kept(docs, shared), "clean")
        if before is not given:
            scratch.drop(before)
    return docs
