"""Spark data sources of the binary containers: ``twobit``, ``fourbit``, ``twobe`` and
``faidx``, to read; the first three, and ``concatenated`` bytes, to write.

Reading gives ``file, ordinal, name, bases``. The driver reads the table of contents
and deals it out in slices; tasks seek and decode. A filter on ``name`` is pushed down: where
a file has an index of names, tasks look up the named entries by it and the table of contents
isn't read; else the table is read and its other entries are left out. An ``ordinal`` of an
entry found by its index costs the places of all entries (8 bytes each by the pointer index,
the tree's leaves else), so it is left out where the schema given to the reader has none.

Writing takes rows in the order of their partitions, so sort by ``ordinal`` first.
Tasks encode records, which hold no absolute offsets, into part files beside the
target; the commit writes header, table of contents and index around a gap, and
``write_container`` lets tasks copy the parts into it before the whole is renamed. A part
is emptied once it is copied, so that a file's bytes are on disk once, but for parts that are
being copied. A plain ``df.write`` copies them in the commit. Target and parts must be in a folder that all
executors share. ``write_shards`` writes a folder of containers instead, in any store, see
``sharded``; it is read like one container, ordinals running through its files.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from genoframe.sources import batch as B
from genoframe.sources import codec as C
from genoframe.sources import sharded
from genoframe.sources.ranged import beside, in_store, is_url, list_store, local_path, open_source
from genoframe.sources.readers import detect, open_reader

SCHEMA = "file string, ordinal long, name string, bases string"
#: Sequences of one input partition, and names that are looked up in one.
SLICE = 2048
NAMES = 512
COPIED = 16 << 20
#: Bytes of a part file; a task writes as many as it needs.
PIECE = 16 << 20
#: Where a record must begin below to be placed by 32 bits; a 2-bit file with one beyond it
#: gets offsets of 64 bits, asked for or not.
SHORT_OFFSETS = 1 << 32


def files_of(path: str, sidecars: bool = False) -> list[str]:
    """The files that a path, a folder or a pattern stands for, those of its manifest if a
    folder has one, without indexes in a folder unless ``sidecars``."""
    if is_url(path):
        return [path]
    listed = sharded.manifest(path)
    if listed is not None:
        return [file for file, _ in listed]
    path = local_path(path)
    if in_store(path) or os.path.isdir(path):
        inside = list_store(path) if in_store(path) else sorted(filter(os.path.isfile, glob.glob(os.path.join(path, "*"))))
        named = [(p, os.path.basename(p.partition("?")[0] if in_store(p) else p)) for p in inside]
        return [p for p, name in named if not name.startswith((".", "_")) and (sidecars or not name.endswith((".fai", ".gzi")))]
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    if not found or not all(map(os.path.exists, found)):
        raise FileNotFoundError(path)
    return found


@dataclass
class Slice(InputPartition):
    file: str
    entries: list[tuple[int, str, int]]


@dataclass
class Named(InputPartition):
    """Names to look up by a file's index, ordinals running on from ``before``."""

    file: str
    names: list[str]
    before: int = 0


@dataclass
class Whole(InputPartition):
    """A file whose table of contents the task reads."""

    file: str
    before: int


@dataclass
class Lines(InputPartition):
    """Bytes of an index of FASTA, from a line's start to another's, and the entries before."""

    file: str
    low: int
    high: int
    before: int


def index_slices(file: str, size: int, chunk: int = COPIED) -> Iterator[Lines]:
    """Slices of a FASTA file's index of ``size`` entries; no more of it is held than a chunk."""
    source = open_source(beside(file, ".fai"))
    low = at = before = count = 0
    rest = b""
    while at < source.size or rest:
        held = rest + source.read_at(at, min(chunk, source.size - at))
        at += len(held) - len(rest)
        *lines, rest = held.split(b"\n")
        if at >= source.size:
            lines, rest = [*lines, rest], b""
        begin = at - len(held)
        for line in lines:
            begin = min(begin + len(line) + 1, source.size)
            count += bool(line.strip())
            if count == size:
                yield Lines(file, low, begin, before)
                low, before, count = begin, before + count, 0
    if count:
        yield Lines(file, low, source.size, before)


class ContainerReader(DataSourceReader):
    def __init__(self, kind: str, path: str, size: int, columns: list[str] | None = None):
        self.kind, self.path, self.size = kind, path, size
        self.columns = columns or [c.split()[0] for c in SCHEMA.split(", ")]
        self.names: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("name",):
                continue
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                named = {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                named = set(f.value)
            else:
                yield f
                continue
            self.names = named if self.names is None else self.names & named
            yield f  # a name may be longer than an index keeps, so rows are filtered once more

    def entries(self, reader) -> list[tuple[int, str, int]]:
        return [e for e in sharded.entries(reader) if self.names is None or e[1] in self.names]

    def opened(self, file: str, lines: tuple[int, int] | None = None):
        reader = open_reader(file, lines)
        if reader.kind != self.kind:
            raise ValueError(f"{file} is a {reader.kind} file, not {self.kind}")
        return reader

    def partitions(self):
        out = []
        listed = sharded.manifest(self.path)
        if listed:  # of one kind and options, so the first tells whether they are indexed
            names = sorted(n for n in self.names or () if n is not None)
            if self.names is None or not self.opened(listed[0][0]).indexed:
                return [Whole(file, before) for file, before in listed]
            out = [Named(file, names[i : i + NAMES], before) for file, before in listed for i in range(0, len(names), NAMES)]
            return out or [Slice("", [])]
        for file in files_of(self.path):
            if self.kind == "faidx" and not is_url(file) and has_index(file):
                out += index_slices(file, self.size)
                continue
            reader = self.opened(file)
            if self.names is not None and reader.indexed:
                names = sorted(n for n in self.names if n is not None)
                out += [Named(file, names[i : i + NAMES]) for i in range(0, len(names), NAMES)]
                continue
            entries = self.entries(reader)
            out += [Slice(file, entries[i : i + self.size]) for i in range(0, len(entries), self.size)]
        return out or [Slice("", [])]

    def found(self, reader, names: list[str]) -> Iterator[tuple[int | None, str, int]]:
        """Ordinal, name and place of all sequences of some names."""
        hits = [(name, place, mark) for name in names for place, mark in reader.find_all(name)]
        ordinals = reader.ordinals_of([m for _, _, m in hits]) if hits and "ordinal" in self.columns else [None] * len(hits)
        return ((i, name, place) for i, (name, place, _) in zip(ordinals, hits, strict=True))

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        lines = (partition.low, partition.high) if isinstance(partition, Lines) else None
        reader, before = self.opened(partition.file, lines), getattr(partition, "before", 0)
        if isinstance(partition, Named):
            entries = self.found(reader, partition.names)
        else:
            entries = self.entries(reader) if isinstance(partition, (Whole, Lines)) else partition.entries
        held, size = [], 0
        for i, name, place in entries:
            held.append((partition.file, None if i is None else before + i, name, reader.extract_at(place)))
            size += len(held[-1][3])
            if size > COPIED:
                yield _batch(held).select(self.columns)
                held, size = [], 0
        if held:
            yield _batch(held).select(self.columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "ordinal", "name", "bases"])


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: how many records, of how many bytes; where a table of contents lists
    them, also names one behind another, and sizes of names and records as bytes."""

    number: int
    path: str
    count: int
    size: int
    names: bytes
    name_sizes: bytes
    sizes: bytes


class Pieces:
    """A task's bytes, in files of PIECE bytes and one of the rest."""

    def __init__(self, path: str):
        self.path, self.size, self.out = path, 0, None

    def write(self, data: np.ndarray) -> None:
        at = 0
        while at < len(data):
            number, held = divmod(self.size, PIECE)
            if not held:
                self.close()
                self.out = open(f"{self.path}-{number}", "wb")  # noqa: SIM115
            some = data[at : at + PIECE - held]
            self.out.write(some)
            at, self.size = at + len(some), self.size + len(some)

    def close(self) -> None:
        if self.out:
            self.out.close()


def pieces_of(part: Part) -> Iterator[tuple[int, str]]:
    """Where the files of a part begin in it, and their paths."""
    return ((low, f"{part.path}-{low // PIECE}") for low in range(0, part.size, PIECE))


def put_piece(out, at: int, piece: str) -> None:
    """Copy a file to its place and empty it, which gives its room back; an empty one was
    copied by an attempt before."""
    with open(piece, "r+b") as data:
        out.seek(at)
        shutil.copyfileobj(data, out, COPIED)
        out.flush()
        os.fsync(out.fileno())  # nothing else holds these bytes then
        data.truncate(0)


class PartsWriter(DataSourceArrowWriter):
    """Writes what ``encode`` makes of batches to part files and joins them in ``commit``."""

    #: Whether records are listed, so that the driver needs their names and sizes.
    listed = False

    def __init__(self, path: str, columns: list[str], plan: str = ""):
        self.path, self.plan = local_path(path), plan
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.columns = columns

    def encode(self, batch: pa.RecordBatch) -> Iterator[tuple[B.Ragged, B.Ragged]]:
        """Names and records of a batch, some rows at a time."""
        raise NotImplementedError

    def around(self, parts: list[Part]) -> tuple[bytes, bytes]:
        """What stands before and after the records of all tasks."""
        return b"", b""

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        number = task.partitionId()
        path = f"{self.parts}/{number}-{task.taskAttemptId()}"
        count = 0
        names, name_sizes, sizes = [], [], []
        with closing(Pieces(path)) as out:
            for batch in iterator:
                for own, records in self.encode(batch):
                    out.write(records.data)
                    count += len(records.sizes)
                    if self.listed:
                        names.append(own.data.tobytes())
                        name_sizes.append(own.sizes.astype("<i4").tobytes())
                        sizes.append(records.sizes.astype("<i8").tobytes())
        return Part(number, path, count, out.size, b"".join(names), b"".join(name_sizes), b"".join(sizes))

    def commit(self, messages):
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        head, tail = self.around(parts)
        whole, at = f"{self.parts}.whole", len(head)
        places = []
        for p in parts:
            places += [(at + low, piece) for low, piece in pieces_of(p)]
            at += p.size
        with open(whole, "wb") as out:
            out.write(head)
            out.seek(at)
            out.write(tail)
            out.truncate()
            for at, piece in [] if self.plan else places:
                put_piece(out, at, piece)
        if self.plan:  # tasks copy the parts
            with open(self.plan, "w", encoding="utf-8") as f:
                f.writelines(f"{x}\n" for x in (whole, self.parts, *(f"{at} {piece}" for at, piece in places)))
            return
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class ConcatenatedWriter(PartsWriter):
    def encode(self, batch):
        data = B.ragged(batch.column("data").fill_null(b""))
        yield B.Ragged(data.data[:0], np.zeros_like(data.at)), data


class SequenceWriter(PartsWriter):
    listed = True

    def around(self, parts):
        of_names = np.frombuffer(b"".join(p.name_sizes for p in parts), "<i4")
        names = B.Ragged(np.frombuffer(b"".join(p.names for p in parts), np.uint8), B.sums(of_names))
        return self.frame(names, np.frombuffer(b"".join(p.sizes for p in parts), "<i8"))

    def frame(self, names: B.Ragged, sizes: np.ndarray) -> tuple[bytes, bytes]:
        """What stands before and after records of some names and sizes."""
        raise NotImplementedError

    def encode(self, batch):
        names, bases = B.ragged(batch.column("name")), B.one_byte_a_base(batch.column("bases"))
        for low, high in B.pieces(bases):
            own = names.part(low, high)
            yield own, self.records(own, bases.part(low, high))

    def records(self, names: B.Ragged, bases: B.Ragged) -> B.Ragged:
        raise NotImplementedError


class TwoBitWriter(SequenceWriter):
    def __init__(self, path, columns, long: bool, iub: bool, index: str, plan: str = ""):
        super().__init__(path, columns, plan)
        if index not in ("none", "ptr", "bpt"):
            raise ValueError(f"unknown index {index}")
        self.long, self.iub, self.index = long, iub, index

    def records(self, names, bases):
        B.check_names(names)
        return B.twobit_records(bases, self.iub)

    def frame(self, names, sizes):
        count, records = len(sizes), B.sums(sizes)
        before = 16 + len(names.data) + 5 * count
        long = self.long or bool(count) and before + int(records[-2]) >= SHORT_OFFSETS
        width = 8 if long else 4
        at = before + (width - 4) * count + records
        toc, entries = B.twobit_toc(names, at[:-1], width)
        head = struct.pack("<IIII", C.TWOBIT_MAGIC, int(long), count, 0) + toc
        footer = struct.pack("<QQI", int(at[-1]), count, int(self.iub))
        if self.index == "ptr":
            order = np.argsort(names.padded(), kind="stable")
            return head, (16 + entries[order]).astype("<u8").tobytes() + footer + C.PTR_FOOTER
        if self.index == "bpt":
            return head, C.build_tree(names.padded(), at[:-1]) + footer + C.BPT_FOOTER
        return head, C.IUB_TRAILER + struct.pack("<I", 1) if self.iub else b""


class FourBitWriter(SequenceWriter):
    listed = False

    def records(self, names, bases):
        return B.fourbit_records(names, bases)

    def around(self, parts):
        return self.header(sum(p.count for p in parts)), b""

    def frame(self, names, sizes):
        return self.header(len(sizes)), b""

    def header(self, count: int) -> bytes:
        return C.FOURBIT_MAGIC + struct.pack("<III", 1, count, 0)


class TwoBeWriter(SequenceWriter):
    def records(self, names, bases):
        return B.twobe_records(bases)

    def frame(self, names, sizes):
        at = 32 + B.sums(sizes)
        return C.TWOBE_MAGIC + struct.pack("<HHQQQ", 1, 0, len(sizes), int(at[-1]), 0), C.build_tree(names.padded(), at[:-1])


class Container(DataSource):
    kind = ""

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ContainerReader(self.kind, self.options["path"], int(self.options.get("slice", SLICE)), schema.names)

    def flag(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def encoder(self, columns: list[str]) -> SequenceWriter:
        raise NotImplementedError

    def writer(self, schema, overwrite):
        encoder = self.encoder(schema.names)
        return sharded.ShardsWriter(encoder, self.options["path"], int(self.options.get("file_bytes", sharded.FILE_BYTES))) if self.flag("shards") else encoder


class TwoBit(Container):
    kind = "twobit"

    def encoder(self, columns):
        return TwoBitWriter(self.options["path"], columns, self.flag("long"), self.flag("iub"), self.options.get("index", "none"), self.options.get("plan", ""))


class FourBit(Container):
    kind = "fourbit"

    def encoder(self, columns):
        return FourBitWriter(self.options["path"], columns, self.options.get("plan", ""))


class TwoBe(Container):
    kind = "twobe"

    def encoder(self, columns):
        return TwoBeWriter(self.options["path"], columns, self.options.get("plan", ""))


class Faidx(Container):
    kind = "faidx"

    def writer(self, schema, overwrite):
        raise ValueError("indexed FASTA is written by write_indexed_fasta")


class Concatenated(DataSource):
    @classmethod
    def name(cls):
        return "concatenated"

    def schema(self):
        return "data binary"

    def writer(self, schema, overwrite):
        return ConcatenatedWriter(self.options["path"], schema.names, self.options.get("plan", ""))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, with filters pushed down."""
    for source in (TwoBit, FourBit, TwoBe, Faidx, Concatenated):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_container(spark: SparkSession, path: str, kind: str, slice: int = SLICE, ordinals: bool = True) -> DataFrame:  # noqa: A002
    """``file, ordinal, name, bases``; without ``ordinals``, a few names are found in an
    indexed file by their nodes alone."""
    if kind == "faidx" and not is_url(path) and not all(map(has_index, files_of(path))):
        from genoframe.sources.fasta import fasta_sequences

        found = fasta_sequences(spark, path)
        return found if ordinals else found.drop("ordinal")
    register(spark)
    read = spark.read.format(kind).option("path", path).option("slice", slice)
    return (read if ordinals else read.schema("file string, name string, bases string")).load()


def write_shards(sequences: DataFrame, path: str, kind: str, **options) -> None:
    """Write ``ordinal, name, bases`` as a folder of containers, in the order of ``ordinal``,
    to a path or a store's URI. ``file_bytes`` are the records' bytes from which on a file is
    closed."""
    register(sequences.sparkSession)
    rows = sequences.orderBy("ordinal").select("name", "bases")
    given = {k: str(v).lower() for k, v in options.items()} | {"shards": "true", "path": path}
    rows.write.format(kind).options(**given).mode("append").save()


def write_container(sequences: DataFrame, path: str, kind: str, **options) -> None:
    """Write ``ordinal, name, bases`` as one file, in the order of ``ordinal``; in a store,
    where nothing is written by position, as a folder of files."""
    if in_store(path):
        return write_shards(sequences, path, kind, **options)
    register(sequences.sparkSession)
    rows = sequences.orderBy("ordinal").select("name", "bases")
    _write_joined(rows.write.format(kind).options(**{k: str(v).lower() for k, v in options.items()}), path, sequences.sparkSession)


def write_bytes(rows: DataFrame, path: str, data: str, order: str) -> None:
    """Write a binary column as one file, in order."""
    register(rows.sparkSession)
    _write_joined(rows.orderBy(order).select(F.col(data).alias("data")).write.format("concatenated"), path, rows.sparkSession)


def _write_joined(write: DataFrameWriter, path: str, spark: SparkSession) -> None:
    """Let tasks write the parts, then let tasks copy each part to its place in the target,
    so that no data passes through the driver."""
    target = local_path(path)
    plan = f"{target}.plan-{uuid.uuid4().hex}"
    write.option("path", path).option("plan", plan).mode("append").save()
    with open(plan, encoding="utf-8") as f:
        whole, parts, *pieces = f.read().splitlines()
    os.remove(plan)
    rows = [(i, path, int(at)) for i, (at, path) in enumerate(x.split(" ", 1) for x in pieces)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(whole, "r+b") as out:
                for piece, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    put_piece(out, at, piece)
            yield batch

    if rows:
        table = spark.createDataFrame(rows, "i long, piece string, at long").repartition(min(len(rows), spark.sparkContext.defaultParallelism), "i")
        table.mapInArrow(place, table.schema).write.format("noop").mode("overwrite").save()
    os.replace(whole, target)
    shutil.rmtree(parts, ignore_errors=True)


def has_index(path: str) -> bool:
    """Whether a FASTA file's ``.fai`` stands beside it; a URL's must."""
    try:
        open_source(beside(path, ".fai"))
    except FileNotFoundError:
        return False
    return True


#: Bases up to which a sequence is decoded whole for its windows.
WHOLE = 1 << 20
#: Requests of one place up to which one task has them all.
HOT = 1 << 16
#: Bytes of a remote file whose requests go to one task, bytes that it looks ahead, and HTTP
#: blocks between two asked-for sequences up to which they are fetched together.
STRETCH = 4 << 20
AHEAD = 8 << 20
NEAR = 31


def extract_regions(spark: SparkSession, path: str, regions: DataFrame, used: tuple | None = None) -> DataFrame:
    """Windows of a container: ``ordinal, name, start, end, bases``; an unknown name is an
    error. Regions are dealt by their name and place, so that a task looks a name up once
    and reads on from one window to the next. A short sequence is decoded once for all of a
    task's windows; of a longer one only what its windows ask for. ``used`` are
    accumulators that the tasks add their HTTP requests and bytes to. The requests of a place
    that has over HOT of them are dealt to several tasks. A file without an index of names has
    its table of contents read once, and requests are joined with it; those to FASTA files are
    joined with their index, and to BGZF files with their blocks too, see ``indexed``. Names of
    a remote file are looked up first, and requests dealt by stretches of it."""
    toc = None
    files = sharded.manifest(path)
    if files is not None:
        return sharded.extract_regions(spark, files, with_parts(regions), WHOLE)
    if not is_url(path):
        source = open_source(path)
        kind = detect(source.read_at(0, min(64, source.size)))
        if kind in ("bgzf", "fasta"):
            from genoframe.sources import indexed

            return indexed.extract_regions(spark, path, regions, kind == "bgzf")
        reader = open_reader(path)
        if not reader.indexed:  # of equal names the last
            toc = spark.createDataFrame(list(dict(reader.toc()).items()), "of string, at long")

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = with_parts(regions)
    if is_url(path):
        # names are looked up in their order, an index's leaf after the other, then requests go
        # by stretches of the file, each of which is fetched by few requests
        toc = asked.select("name").distinct().repartition(shuffled, "name").sortWithinPartitions("name").mapInArrow(places_of(path, used), "of string, at long, stretch long")
        met = asked.join(toc, F.col("name").eqNullSafe(F.col("of")), "left")
        dealt = met.repartition(shuffled, "stretch", "_place", "_part").sortWithinPartitions("at", "name", "start")
    else:
        if toc is None:
            asked = asked.withColumn("at", F.lit(None).cast("long"))
        else:
            missing = F.raise_error(F.concat(F.lit('no sequence named "'), "name", F.lit('"'))).cast("long")
            asked = asked.join(toc, F.col("name") == F.col("of"), "left").withColumn("at", F.coalesce("at", missing))
        dealt = asked.repartition(shuffled, "name", "_place", "_part").sortWithinPartitions("at", "name", "start")
    return dealt.select("ordinal", "name", "start", "end", "at").mapInArrow(windows_of(path, used), "ordinal long, name string, start long, end long, bases string")


def _found(reader, name: str) -> int:
    place = reader.find(name)
    if place is None:
        raise KeyError(f'no sequence named "{name}"')
    return place


def _count_used(reader, used: tuple | None) -> None:
    for counter, n in zip(used or (), reader.http_stats(), strict=False):
        counter.add(n)


def places_of(path: str, used: tuple | None):
    """Names to their places and stretches of the file, or of its index where places number that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or open_reader(path)
            at = pa.array([_found(reader, name) for name in batch.column(0).to_pylist()], pa.int64())
            stretch = pa.array(at.to_numpy() // (SLICE if reader.kind == "faidx" else STRETCH), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), at, stretch], names=["of", "at", "stretch"])
        if reader:
            _count_used(reader, used)

    return run


def windows_of(path: str, used: tuple | None):
    """Requests' bases, of rows that stand together by name; ``at`` is their place, if known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = open_reader(path)
        known, place, whole = None, None, None
        for batch in batches:
            names, starts, ends, given = (c.to_pylist() for c in batch.columns[1:])
            places: dict[str, int] = {}
            for name, at in zip(names, given, strict=True):
                if name not in places:
                    places[name] = place if name == known else _found(reader, name) if at is None else at
            # a reader's places are bytes of the file but for FASTA, where they number its index
            soon = list(places.values()) if reader.kind != "faidx" else []
            numbers = {name: i for i, name in enumerate(places)}
            ahead = 0
            bases = []
            for name, start, end in zip(names, starts, ends, strict=True):
                if name != known:
                    place, whole = places[name], None
                    known = name
                    if soon and numbers[name] >= ahead:
                        first = ahead = numbers[name]
                        while ahead < len(soon) and soon[ahead] < soon[first] + AHEAD:
                            ahead += 1
                        reader.source.prefetch(soon[first : ahead + 1], NEAR)
                    short = reader.length_at(place) <= WHOLE
                if short and whole is None:
                    whole = reader.extract_at(place)
                bases.append(whole[start or 0 : end] if short else reader.extract_at(place, start or 0, end))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bases, pa.string())], names=["ordinal", "name", "start", "end", "bases"])
        _count_used(reader, used)

    return run


def with_parts(regions: DataFrame) -> DataFrame:
    """Requests with the place and part by which they are dealt: a name's requests by where
    they start, and those of a place with over HOT of them by their own hash too."""
    asked = regions.select("ordinal", "name", "start", "end", F.floor(F.col("start") / (4 * WHOLE)).alias("_place"))
    hot = asked.groupBy("name", "_place").agg(F.ceil(F.count(F.lit(1)) / HOT).alias("_parts")).where("_parts > 1")
    hot = hot.select(F.col("name").alias("_name"), F.col("_place").alias("_at"), "_parts")
    met = asked.join(hot, F.col("name").eqNullSafe(F.col("_name")) & F.col("_place").eqNullSafe(F.col("_at")), "left")
    return met.withColumn("_part", F.pmod(F.xxhash64("ordinal", "start", "end"), F.coalesce("_parts", F.lit(1)))).drop("_name", "_at", "_parts")
