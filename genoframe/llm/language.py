"""Language identification by compression.

Each language has a raw-content zstandard dictionary: whole texts of a bounded,
hash-chosen sample of its labelled rows. Dictionaries are fitted and compared by slices of
SLICE languages: a pass over the rows for each slice keeps the smallest size so far, the
next one and the sum that the score needs, so any number of languages has bounded memory. Letters are lower-cased and whatever stands between runs of
letters becomes a space. A text is then compressed in blocks of ``BLOCK_BYTES``
with every dictionary, and the smallest total names the language.
Blocks keep the dictionary's share in a long text's size; all of the text counts.

The prediction is ``accepted`` where the runner-up needs at least
``MIN_MARGIN_BYTES`` and ``MIN_MARGIN`` of the winner's size more.

Defined results: ``und`` with score 0, not accepted, where the text is null or
has no letter or nothing was learned; equal sizes go to the language that sorts
first; repeated rows give repeated results; columns that are not named are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from genoframe.llm.rows import by_place, keep_rows
from genoframe.llm.scratch import Scratch

#: Bounds of the fit: rows drawn for a language and bytes of its dictionary.
SAMPLE_ROWS = 200
DICT_BYTES = 112 << 10
#: Languages whose dictionaries are in memory together.
SLICE = 256
#: Longer texts aren't drawn for a dictionary.
SAMPLE_CHARS = 40_000
LEVEL = 9
BLOCK_BYTES = 4096
MIN_MARGIN_BYTES = 1
MIN_MARGIN = 0.001
UNKNOWN = "und"

_gaps = re.compile(r"[\W\d_]+").sub


def letters(text: str) -> bytes:
    return _gaps(" ", text.lower()).encode("utf-8")


def hash_below(key, share):
    """Whether a row's hash lies in the lowest ``share`` of all hashes."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share * float(1 << 40)


class Learned:
    """The labelled rows' languages, whose dictionaries are fitted a slice at a time."""

    def __init__(self, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"):
        rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        self.rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
        self.counts = {r["lang"]: r["n"] for r in self.rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def slices(self) -> Iterator[dict[str, bytes]]:
        """Dictionaries of some languages after others; one without any if there are none."""
        names = sorted(self.counts)
        for at in range(0, max(1, len(names)), SLICE):
            yield self.fit(names[at : at + SLICE])

    def fit(self, names: list[str]) -> dict[str, bytes]:
        if not names:
            return {}
        share = F.create_map(*(F.lit(x) for k in names for x in (k, SAMPLE_ROWS / self.counts[k])))
        drawn = self.rows.where(F.col("lang").isin(names)).where(hash_below("key", share[F.col("lang")])).where(F.length("text") <= SAMPLE_CHARS)
        texts: dict[str, list[str]] = {}
        for r in drawn.orderBy(F.xxhash64("key"), "text").limit(2 * SAMPLE_ROWS * len(names)).collect():
            texts.setdefault(r["lang"], []).append(r["text"])
        return {k: letters("\n".join(v))[-DICT_BYTES:] for k, v in sorted(texts.items())}


def fit_dictionaries(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The dictionary of each language of rows whose text and ``lang`` are not null."""
    return {k: v for part in Learned(labelled, key, text, lang).slices() for k, v in part.items()}


#: Smallest size, its language, the next size, and the sum of odds relative to the smallest.
Best = tuple[int, str | None, int | None, float]
NONE: Best = (0, None, None, 0.0)


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries  # kept, so that no other one takes its identity
        self.names = sorted(dictionaries)
        self.codecs = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = letters(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c(b)) for b in blocks) for c in self.codecs]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return decided(self.best(text))

    def best(self, text: str | None, before: Best = NONE) -> Best:
        """The best language of these and of those before."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return before
        order = sorted(zip(self.sizes(text), self.names, strict=True))
        size, name = order[0]
        # the winner's share if each language's odds fall with the bytes it needs more
        own = (size, name, order[1][0] if len(order) > 1 else None, sum(math.exp(-(s - size) / 2) for s, _ in order))
        if before[1] is None:
            return own
        first, other = sorted((own, before), key=lambda x: x[:2])
        return (*first[:2], min(x for x in (first[2], other[0]) if x is not None), first[3] + other[3] * math.exp(-(other[0] - first[0]) / 2))


def decided(best: Best) -> tuple[str, float, bool]:
    """Language, score and whether it is accepted."""
    size, name, second, odds = best
    if name is None:
        return UNKNOWN, 0.0, False
    if second is None:
        return name, 1.0, True
    return name, 1 / odds, second - size >= max(MIN_MARGIN_BYTES, MIN_MARGIN * size)


_loaded: dict[int, Compressors] = {}


def _compressors(dictionaries: dict[str, bytes]) -> Compressors:
    if id(dictionaries) not in _loaded:
        _loaded.clear()
        _loaded[id(dictionaries)] = Compressors(dictionaries)
    return _loaded[id(dictionaries)]


_STATE = "size long, name string, second long, odds double"


def _compared(rows: DataFrame, learned: Learned | dict[str, bytes]) -> tuple[DataFrame, dict[str, bytes]]:
    """``rows`` of ``text`` and others with what slices but the last say, and the last slice.
    A pass for each slice writes a table, which the next one reads."""
    slices = learned.slices() if isinstance(learned, Learned) else iter([learned])
    last, scratch, before = next(slices), Scratch(rows.sparkSession), None
    for following in slices:
        rows = scratch.table(_pass(rows, last, lambda best: best, _STATE), "languages")
        if before is not None:
            scratch.drop(before)
        before, last = rows, following
    return rows, last


def _pass(rows: DataFrame, dictionaries: dict[str, bytes], finish: Callable[[Best], tuple], schema: str) -> DataFrame:
    """Rows without their state, if they have one, and what ``finish`` makes of the new one."""
    model = rows.sparkSession.sparkContext.broadcast(dictionaries)
    state = [c.split()[0] for c in _STATE.split(", ")]
    started = rows.columns[-4:] == state
    kept = rows.columns[:-4] if started else rows.columns
    at_text = kept.index("text")
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = _compressors(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(at_text).to_pylist()
                before = zip(*(part.column(len(kept) + i).to_pylist() for i in range(4)), strict=True) if started else [NONE] * len(texts)
                found = [finish(codecs.best(t, b)) for t, b in zip(texts, before, strict=True)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*kept, *names])

    found = StructType([*rows.select(kept).schema.fields, *rows.sparkSession.createDataFrame([], schema).schema.fields])
    return rows.mapInArrow(run, found)


def drop_unknown(docs: DataFrame, learned: Learned | dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows, as they are, whose prediction is accepted."""
    plain = by_place(docs)
    place = f"c{docs.columns.index(text)}"
    rows, last = _compared(plain.withColumnRenamed(place, "text"), learned)
    model = docs.sparkSession.sparkContext.broadcast(last)
    if len(rows.columns) == len(docs.columns):

        def decider():
            codecs = _compressors(model.value)
            return lambda texts: [codecs.predict(t)[2] for t in texts]

        return keep_rows(docs, text, decider)
    judged = _pass(rows, last, lambda best: (decided(best)[2],), "accepted boolean")
    return judged.where("accepted").drop("accepted").toDF(*docs.columns)


def identify(docs: DataFrame, learned: Learned | dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``accepted`` of every row; a pass without a
    shuffle for each slice of languages."""
    rows, last = _compared(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), learned)
    found = _pass(rows, last, decided, "lang_pred string, score double, accepted boolean")
    return found.select(F.col("key").alias(key), "lang_pred", "score", "accepted")
