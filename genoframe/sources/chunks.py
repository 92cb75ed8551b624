"""Files read in chunks of bytes by many tasks: FASTA records of any length, and BGZF blocks.

A chunk of a FASTA file doesn't know whether its first bytes are a header's, a sequence's or
a line's blanks. A first pass gives what each chunk makes of either, in a few numbers: the
state it ends in, records it opens, bases before the first and behind the last of them.
Windows over a file's chunks put these together, so a second pass knows of each chunk where
it begins: in which state, record and base. Records within a chunk are then whole; of those
that span chunks only the pieces are shuffled. Bases come as tiles, so no row holds a whole
long sequence.

A BGZF file is cut the same way. A block begins within the first 64 KiB of a split, if at all;
each place there that looks like one is followed, by the blocks' sizes, beyond the split's
end. From a file's first byte on only one of these chains is real in each split, so bytes in
a block that look like another one are passed over.

What passes through one task is a file's rows of this kind: one for each chunk. Of a
chunk's bytes a worker holds a few times as many, however long the file: a byte or two for
each, and wider numbers of lines and blanks only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.operators.regions import TILE
from genoframe.sources.containers import files_of
from genoframe.sources.ranged import open_source
from genoframe.sources.readers import inflate_block, is_bgzf

#: Bytes of a chunk, compressed ones for BGZF.
CHUNK = 4 << 20
BLOCK = 1 << 16
#: At a line's start or in the blanks behind it; in a header; in a line of bases.
BLANKS, HEADER, BASES = 0, 1, 2
#: Of each byte, whether it is not blank.
SOLID = bytes(b not in b" \t\n\f\r" for b in range(256))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows that stand for work, dealt to as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def file_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``file, chunk, start, stop, size`` (the file's) of all files, none of which is read."""
    files = files_of(path)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)), "file")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([open_source(f).size for f in b.column(0).to_pylist()], pa.int64())], names=["file", "size"])

    cut = listed.mapInArrow(sizes, "file string, size long").where("size > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {chunk}"))))
    start = F.col("chunk") * chunk
    return cut.select("file", "chunk", start.alias("start"), F.least(start + chunk, "size").alias("stop"), "size")


# -- BGZF ------------------------------------------------------------------------
def follow(held: bytes, base: int, at: int, stop: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Place, size and plain size of the blocks from ``at`` on that begin before ``stop``, from
    bytes that stand at ``base`` in a file of ``size``; raises where there is none."""
    while at < stop:
        head = held[at - base : at - base + 18]
        whole = struct.unpack("<H", head[16:18])[0] + 1 if len(head) == 18 and is_bgzf(head) else 0
        if whole < 26:
            raise ValueError(f"no BGZF block at {at}")
        if at + whole > size:
            raise ValueError("a BGZF block is cut short")
        yield at, whole, struct.unpack("<I", held[at + whole - 4 - base : at + whole - base])[0]
        at += whole


def chains(held: bytes, start: int, stop: int, size: int) -> list[tuple[int, int, int]]:
    """Of each place in a split where a block may begin: the place, where its chain leaves the
    split, and how many bytes its blocks hold. Chains that break are left out."""
    known: dict[int, tuple[int, int] | None] = {}
    out = []
    at = held.find(b"\x1f\x8b\x08\x04")
    while 0 <= at < min(BLOCK, stop - start):
        way, p, end = [], start + at, None
        try:
            for p, whole, plain in follow(held, start, start + at, stop, size):
                if p in known:
                    end = known[p]
                    break
                way.append((p, plain))
                end = (p + whole, 0)
        except ValueError:
            end = None
        for p, plain in reversed(way):
            end = known[p] = None if end is None else (end[0], end[1] + plain)
        if known.get(start + at):
            out.append((start + at, *known[start + at]))
        at = held.find(b"\x1f\x8b\x08\x04", at + 1)
        if start == 0:
            break  # a file begins with a block
    return out


def bgzf_splits(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``file, chunk, start, stop, text`` of BGZF files: splits from a block's first byte to
    another's, and the place of their first byte in what the file holds."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, k, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = open_source(file).read_at(start, min(size, stop + BLOCK) - start)
                rows += [(file, k, stop, size, *c) for c in chains(held, start, stop, size)] or [(file, k, stop, size, -1, -1, 0)]
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["file", "chunk", "stop", "size", "enter", "leave", "plain"])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        at = done = 0
        out = []
        for k, stop, enter, leave, plain in rows.sort_values(["chunk", "enter"])[["chunk", "stop", "enter", "leave", "plain"]].itertuples(index=False):
            if enter == at and at < stop:
                out.append((rows["file"].iloc[0], k, at, leave, done))
                at, done = leave, done + plain
        if at != rows["size"].iloc[0]:
            raise ValueError(f"{rows['file'].iloc[0]}: no BGZF block at {at}, or it is cut short")
        return pd.DataFrame(out, columns=["file", "chunk", "start", "stop", "text"])

    found = _spread(file_chunks(spark, path, chunk), "file", "chunk").mapInArrow(look, "file string, chunk long, stop long, size long, enter long, leave long, plain long")
    return found.groupBy("file").applyInPandas(walk, "file string, chunk long, start long, stop long, text long")


def bgzf_block_table(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``file, c_start, c_len, u_start, u_len`` of BGZF files' blocks, found by tasks; empty
    blocks are passed over."""

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, _, start, stop, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, whole, plain in follow(open_source(file).read_at(start, stop - start), start, start, stop, stop):
                    if plain:
                        rows.append((file, at, whole, text, plain))
                    text += plain
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), *[pa.int64()] * 4))], names=["file", "c_start", "c_len", "u_start", "u_len"])

    return _spread(bgzf_splits(spark, path, chunk), "file", "chunk").mapInArrow(hop, "file string, c_start long, c_len long, u_start long, u_len long")


def text_of(file: str, start: int, stop: int, packed: bool) -> np.ndarray:
    """The text of a chunk; of BGZF splits, what their blocks hold."""
    held = open_source(file).read_at(start, stop - start)
    if packed:
        held = b"".join(inflate_block(held[at - start : at - start + whole]) for at, whole, plain in follow(held, start, start, stop, stop) if plain)
    return np.frombuffer(held, np.uint8)


# -- FASTA -----------------------------------------------------------------------
@dataclass
class Lines:
    """A chunk's lines, its first and last being parts of lines that may go on beyond it."""

    start: np.ndarray
    stop: np.ndarray  # before the line's end
    first: np.ndarray  # its first character that isn't blank, or 0
    solid: np.ndarray  # of each byte, whether it is not blank
    count: np.ndarray  # how many of a line's bytes are not blank
    closed: bool  # whether a line ends in the chunk


def lines_of(t: np.ndarray) -> Lines:
    ends = np.flatnonzero(t == 10)
    start, stop = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(t)]])
    solid = np.frombuffer(t.tobytes().translate(SOLID), bool)
    blanks = np.flatnonzero(~solid)
    low = np.searchsorted(blanks, start)
    count = stop - start - (np.searchsorted(blanks, stop) - low)
    # a line that begins with blanks goes on behind the run of them
    some = np.flatnonzero(count)
    place = start[some]
    led = ~solid[place]
    last = np.append(np.flatnonzero(np.diff(blanks) > 1), len(blanks) - 1)
    place[led] = blanks[last[np.searchsorted(last, low[some[led]])]] + 1
    first = np.zeros(len(start), np.uint8)
    first[some] = t[place]
    return Lines(start, stop, first, solid, count, bool(len(ends)))


def settled(first: int, state: int) -> int:
    """The state behind a part of a line that was begun in a state."""
    return state if state or not first else HEADER if first == ord(">") else BASES


SUMMARY = "file string, chunk long, start long, stop long, text long, bytes long, first int, lead long, closed boolean, heads long, before long, after long, state int"
PIECES = "file string, record long, header string, total long, tile long, at long, bases binary, whole boolean"
INDEX = (
    "file string, record long, header string, length long, returns long, offset long, content long, end_after long, n_after long, end_first long, n_first long, at long, last long, whole boolean"
)


def summary_row(file: str, k: int, start: int, stop: int, text: int, packed: bool) -> tuple:
    """What a chunk makes of any state; its arrays are dropped before the next chunk is read."""
    t = text_of(file, start, stop, packed)
    x = lines_of(t)
    heads = np.flatnonzero(x.first[1:] == ord(">")) + 1
    bases = np.where(x.first == ord(">"), 0, x.count)
    before, after = (bases[1 : heads[0]].sum(), bases[heads[-1] :].sum()) if len(heads) else (bases[1:].sum(), 0)
    return file, k, start, stop, text, len(t), int(x.first[0]), int(x.count[0]), x.closed, len(heads), int(before), int(after), settled(int(x.first[-1]), BLANKS) if x.closed else None


def _summary(chunks: DataFrame, packed: bool) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary_row(*c, packed) for c in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            kinds = (pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    return chunks.mapInArrow(look, SUMMARY)


def _entered(summary: DataFrame) -> DataFrame:
    """Chunks with the ``state``, ``record`` (opened so far) and ``base`` that they begin in."""
    by = Window.partitionBy("file").orderBy("chunk")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy("file", "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("first") == ord(">"), HEADER).when(F.col("first") > 0, BASES)
    # behind the last chunk in which a line ended, the first that isn't blank says what the line is
    rows = summary.withColumns({"set": F.last("state", ignorenulls=True).over(past), "part": F.count("state").over(past)})
    rows = rows.withColumn("opened", F.first(F.when(F.col("state").isNull(), opens), ignorenulls=True).over(since))
    entered = F.when(F.coalesce("set", F.lit(BLANKS)) == BLANKS, F.coalesce("opened", F.lit(BLANKS))).otherwise(F.col("set"))
    rows = rows.withColumn("entered", entered)
    opens_head = (F.col("entered") == BLANKS) & (F.col("first") == ord(">"))
    is_bases = (F.col("entered") == BASES) | ((F.col("entered") == BLANKS) & (F.col("first") > 0) & ~opens_head)
    lead = F.when(is_bases, F.col("lead")).otherwise(0)
    rows = rows.withColumns({
        "own": F.col("heads") + opens_head.cast("long"),
        "ahead": F.when(opens_head, 0).otherwise(lead + F.col("before")),
        "behind": F.when(F.col("heads") > 0, F.col("after")).when(opens_head, F.col("before")),
    })
    rows = rows.withColumns({"record": F.coalesce(F.sum("own").over(past), F.lit(0)), "carried": F.lag("behind").over(by)})
    same = Window.partitionBy("file", "record").orderBy("chunk")
    base = F.coalesce(F.sum("carried").over(same.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.coalesce(F.sum("ahead").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("file", "chunk", "start", "stop", "text", F.col("entered").alias("state"), "record", base.alias("base"))


def _chunks(spark: SparkSession, path: str, chunk: int) -> tuple[DataFrame, bool]:
    files = files_of(path)
    source = open_source(files[0]) if files else None
    packed = source is not None and is_bgzf(source.read_at(0, min(18, source.size)))
    found = bgzf_splits(spark, path, chunk) if packed else file_chunks(spark, path, chunk).select("file", "chunk", "start", "stop", F.col("start").alias("text"))
    return _spread(found, "file", "chunk"), packed


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of bytes that follow one another, by where they begin and the last ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


@dataclass
class Segments:
    """Parts of a chunk that belong to one record each, the first to that it begins in."""

    record: np.ndarray
    head: np.ndarray  # line of the header, or -1
    bases: np.ndarray  # of each line
    is_header: np.ndarray  # of each line
    bounds: np.ndarray  # lines at which segments begin, and the last ends


def segments_of(x: Lines, state: int, record: int) -> Segments:
    is_header = x.first == ord(">")
    is_header[0] = settled(int(x.first[0]), state) == HEADER
    opens = is_header.copy()
    opens[0] &= state == BLANKS
    heads = np.flatnonzero(opens)
    bases = np.where(is_header, 0, x.count)
    if not record and bases[: heads[0] if len(heads) else None].any():
        raise ValueError("FASTA does not start with a '>' header")
    return Segments(np.arange(record - 1, record + len(heads)), np.concatenate([[-1], heads]), bases, is_header, np.concatenate([[0], heads, [len(x.start)]]))


def _headers(t: np.ndarray, x: Lines, s: Segments, state: int) -> tuple[list[str | None], np.ndarray]:
    """Of each segment its header as far as it is in the chunk, and whether that is all of it."""
    texts: list[str | None] = []
    for k, line in enumerate(s.head):
        if line < 0:
            part = t[: x.stop[0]] if state == HEADER else None
        else:
            part = t[x.start[line] : x.stop[line]]
        text = None if part is None else part.tobytes().decode("utf-8", "replace")
        texts.append(text if text is None or line < 0 else text.lstrip(" \t\n\f\r")[1:])
    done = s.head >= 0
    done[-1] &= s.head[-1] < len(x.start) - 1
    return texts, done


def _pieces(entered: DataFrame, packed: bool, tile: int) -> DataFrame:
    """Bases of all records by tile, with what is known of the record in the chunk. Rows that
    are not ``whole`` belong to records that span chunks; of their headers' parts, ``tile``
    is -1 and ``at`` the place in the file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, _, start, stop, text, state, record, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = text_of(file, start, stop, packed)
                if not len(t):
                    continue
                x = lines_of(t)
                s = segments_of(x, state, record)
                headers, _ = _headers(t, x, s, state)
                sums = np.concatenate([[0], np.cumsum(s.bases)])
                n = np.diff(sums[s.bounds])
                at = np.zeros(len(n), np.int64)
                at[0] = base
                # a segment is whole if its record begins and ends in the chunk
                whole = s.head >= 0
                whole[-1] = False
                data = t[x.solid & np.repeat(~s.is_header, np.diff(np.append(x.start, len(t))))]
                # an empty record that is whole has one empty tile
                pieces = np.where(n > 0, (at + n - 1) // tile - at // tile + 1, whole)
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                number += (at // tile)[row]
                low, high = np.maximum(at[row], number * tile), np.minimum((at + n)[row], (number + 1) * tile)
                ends = np.concatenate([[0], np.cumsum(high - low)])
                texts = [headers[r] if w else None for r, w in zip(row.tolist(), whole[row].tolist(), strict=True)]
                yield _rows(file, s.record[row], texts, np.where(whole[row], n[row], 0), number, low - number * tile, _binary(data, ends), whole[row])
                parts = [k for k, h in enumerate(headers) if h is not None and not whole[k]]
                if parts:
                    places = np.array([text + (x.start[max(0, int(s.head[k]))]) for k in parts])
                    none = np.zeros(len(parts), np.int64)
                    yield _rows(file, s.record[parts], [headers[k] for k in parts], none, none - 1, places, pa.array([b""] * len(parts), pa.binary()), none > 0)

    def _rows(file, record, header, total, number, at, bases, whole) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(record), pa.string()), pa.array(record, pa.int64()), pa.array(header, pa.string()), pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(at, pa.int64()), bases, pa.array(whole)], names=[c.split()[0] for c in PIECES.split(", ")])

    return entered.mapInArrow(cut, PIECES)


def _joined(part: str, order: str):
    """Texts in order, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part]), "")


def fasta_tiles(spark: SparkSession, path: str, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """``file, ordinal, name, tile, total, bases`` of FASTA files, plain or all of them BGZF:
    of each record, whatever its length, a row for each ``tile`` bases. ``ordinal`` counts a
    file's records from 0. Bases are bytes. Data before the first header is an error when read."""
    chunks, packed = _chunks(spark, path, chunk)
    pieces = _pieces(_spread(_entered(_summary(chunks, packed)), "file", "chunk"), packed, tile)
    whole = pieces.where("whole").select("file", "record", "header", "total", "tile", F.col("bases").cast("string").alias("bases"))
    parts = pieces.where("NOT whole")
    headers = parts.where("tile < 0").groupBy("file", "record").agg(_joined("header", "at").alias("header"))
    held = parts.where("tile >= 0").withColumn("bases", F.col("bases").cast("string"))
    tiles = held.groupBy("file", "record", "tile").agg(_joined("bases", "at").alias("bases"))
    totals = held.groupBy("file", "record").agg(F.sum(F.octet_length("bases")).cast("long").alias("total"))
    spanning = headers.join(totals, ["file", "record"], "left").join(tiles, ["file", "record"], "left")
    spanning = spanning.select("file", "record", "header", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("tile", F.lit(0)).alias("tile"), F.coalesce("bases", F.lit("")).alias("bases"))
    name = F.regexp_extract("header", "^([^ \\t\\n\\f\\r]*)", 1)
    return whole.unionAll(spanning).select("file", F.col("record").alias("ordinal"), name.alias("name"), "tile", "total", "bases")


def index_rows(file: str, start: int, stop: int, text: int, state: int, record: int, packed: bool) -> pa.RecordBatch | None:
    """Of each record what a chunk holds of its index."""
    t = text_of(file, start, stop, packed)
    if not len(t):
        return None
    x = lines_of(t)
    s = segments_of(x, state, record)
    headers, done = _headers(t, x, s, state)
    # bytes of lines that are neither header nor ends of lines
    places = np.flatnonzero(t == 13)
    returns = np.where(s.is_header, 0, np.searchsorted(places, x.stop) - np.searchsorted(places, x.start))
    held = np.where(s.is_header, 0, x.stop - x.start - returns)
    sums = np.concatenate([[0], np.cumsum(held)])
    length = np.diff(sums[s.bounds])
    cr = np.concatenate([[0], np.cumsum(returns)])[s.bounds]
    # the first line of data, and the first that isn't empty; -1 where there is none
    first = np.where(s.head >= 0, s.head + 1, int(s.is_header[0]))
    full = np.append(np.flatnonzero(held), len(x.start))
    line = full[np.searchsorted(full, first)]
    inside, known = first < s.bounds[1:], line < s.bounds[1:]
    head_ends = done | ((s.head < 0) & (state == HEADER) & x.closed)
    last_line = len(x.start) - 1
    first, line = np.minimum(first, last_line), np.minimum(line, last_line)
    numbers = (
        s.record, length, np.diff(cr), np.where(head_ends, text + x.start[first], -1), np.where(known, text + x.start[line], -1), np.where(known & (line < last_line), text + x.stop[line], -1), np.where(known, held[line], 0),
        np.where(inside & (first < last_line), text + x.stop[first], -1), np.where(inside, held[first], 0), text + x.start[s.bounds[:-1]],
        np.where(s.bounds[1:] <= last_line, text + x.start[np.minimum(s.bounds[1:], last_line)], text + len(t)),
    )
    whole = s.head >= 0
    whole[-1] = False
    keep = s.record >= 0
    record_, *rest = (pa.array(v[keep], pa.int64()) for v in numbers)
    texts = pa.array([h for h, k in zip(headers, keep.tolist(), strict=True) if k], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([file] * int(keep.sum()), pa.string()), record_, texts, *rest, pa.array(whole[keep])], names=[c.split()[0] for c in INDEX.split(", ")])


def fasta_index(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``file, ordinal, name, length, offset, linebases, linewidth`` of FASTA files without an
    index, plain or all of them BGZF, in which case offsets are places in what they hold. A
    record's first line that isn't empty gives its lines' sizes; carriage returns aren't bases."""
    chunks, packed = _chunks(spark, path, chunk)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, _, start, stop, text, state, record, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = index_rows(file, start, stop, text, state, record, packed)
                if found is not None:
                    yield found

    rows = _spread(_entered(_summary(chunks, packed)), "file", "chunk").mapInArrow(look, INDEX)
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rows = rows.withColumns({c: known(c) for c in ("offset", "content", "end_after", "end_first")})
    # of a record that spans chunks, the first line that isn't empty may begin in one and end in another
    of = Window.partitionBy("file", "record")
    parts = rows.where("NOT whole").withColumn("begin", F.min("content").over(of))
    here, later = F.col("content") == F.col("begin"), F.col("at") > F.col("begin")
    parts = parts.withColumn("end", F.min(F.when(here, F.col("end_after")).when(later, F.col("end_first"))).over(of))
    of_line = F.when(here, F.col("n_after")).when(later & (F.col("end").isNull() | (F.col("at") <= F.col("end"))), F.col("n_first"))
    spanning = parts.groupBy("file", "record").agg(
        _joined("header", "at").alias("header"), F.sum("length").alias("length"), F.sum("returns").alias("returns"), F.max("offset").alias("offset"), F.first("begin").alias("content"), F.first("end").alias("end"),
        F.coalesce(F.sum(of_line), F.lit(0)).alias("linebases"), F.max("last").alias("last"),
    )
    whole = rows.where("whole").select("file", "record", "header", "length", "returns", "offset", "content", F.col("end_after").alias("end"), F.col("n_after").alias("linebases"), "last")
    every = whole.unionAll(spanning)
    offset = F.coalesce("offset", "last")
    # the last line of a file may have no end; of a sequence without bases the last of its empty lines counts
    empty = F.when(F.col("last") <= offset, 0).when(F.col("returns") > 0, 2).otherwise(1)
    width = F.when(F.col("content").isNull(), empty).when(F.col("end").isNull(), F.col("last") - F.col("content")).otherwise(F.col("end") - F.col("content") + 1)
    name = F.regexp_extract("header", "^[ \\t\\f\\r]*([^ \\t\\n\\f\\r]*)", 1)
    return every.select("file", F.col("record").alias("ordinal"), name.alias("name"), "length", offset.alias("offset"), "linebases", width.cast("long").alias("linewidth"))
