"""Containers of many files: a folder, or a prefix of a store, whose files are containers of
their own.

A task encodes its rows and writes a file whenever it holds FILE_BYTES of records, so its
memory doesn't grow with its rows, nothing is written by position and nothing is copied: any
store that Arrow's file systems know will do. File names hold the task's attempt. The commit
writes a manifest of the files that count, in order and with their numbers of sequences;
readers go by it, so files of lost attempts don't matter. A folder that has a manifest is not
written again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from genoframe.sources import batch as B
from genoframe.sources.ranged import beneath, in_store, is_url, local_path
from genoframe.sources.readers import TwoBeReader, open_reader

if TYPE_CHECKING:
    from genoframe.sources.containers import SequenceWriter

MANIFEST = "_manifest"
#: Bytes of records from which on a file is written.
FILE_BYTES = 64 << 20
#: Files whose tables of contents a task reads for one row of its input.
TABLES = 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if in_store(path) else (fs.LocalFileSystem(), os.path.abspath(local_path(path)))


def manifest(path: str) -> list[tuple[str, int]] | None:
    """Files and how many sequences stand before each; None of what has no manifest."""
    if is_url(path):
        return None
    store, inside = store_of(path)
    if store.get_file_info(f"{inside}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{inside}/{MANIFEST}") as f:
        rows = [line.split(" ", 1) for line in f.read().decode().splitlines()]
    before = np.cumsum([0, *(int(n) for n, _ in rows)]).tolist()
    return [(beneath(local_path(path), name), at) for (_, name), at in zip(rows, before, strict=False)]


@dataclass
class Written(WriterCommitMessage):
    number: int
    files: list[tuple[int, str]]


class ShardsWriter(DataSourceArrowWriter):
    """Writes a container's records to files of their own."""

    def __init__(self, inner: SequenceWriter, path: str, file_bytes: int = FILE_BYTES):
        self.inner, self.path, self.file_bytes, self.job = inner, path, file_bytes, uuid.uuid4().hex[:8]
        store, inside = store_of(path)
        if store.get_file_info(f"{inside}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} has a manifest already")

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, inside = store_of(self.path)
        store.create_dir(inside, recursive=True)
        out, held, size = Written(task.partitionId(), []), [], 0

        def flush() -> None:
            names = B.Ragged(np.concatenate([n.data for n, _ in held]), B.sums(np.concatenate([n.sizes for n, _ in held])))
            head, tail = self.inner.frame(names, np.concatenate([r.sizes for _, r in held]))
            name = f"part-{out.number:05d}-{len(out.files):05d}-{self.job}-{task.taskAttemptId()}"
            with store.open_output_stream(f"{inside}/{name}") as f:
                f.write(head)
                for _, records in held:
                    f.write(records.data.tobytes())
                f.write(tail)
            out.files.append((len(names.sizes), name))

        for batch in iterator:
            for names, records in self.inner.encode(batch):
                if not len(names.sizes):
                    continue
                held.append((names, records))
                size += len(records.data)
                if size >= self.file_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out

    def commit(self, messages):
        store, inside = store_of(self.path)
        store.create_dir(inside, recursive=True)
        lines = [f"{n} {name}\n" for m in sorted((m for m in messages if m), key=lambda m: m.number) for n, name in m.files]
        made = f"{inside}/{MANIFEST}-{self.job}"
        with store.open_output_stream(made) as f:
            f.write("".join(lines).encode())
        store.move(made, f"{inside}/{MANIFEST}")

    def abort(self, messages):
        store, inside = store_of(self.path)
        for m in messages:
            for _, name in m.files if m else []:
                store.delete_file(f"{inside}/{name}")


def contents(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Names of all sequences with their file, its number and their place in it, read by
    tasks."""
    rows = [(i, file) for i, (file, _) in enumerate(files)]
    table = spark.createDataFrame(rows, "number long, file string").repartition(max(1, len(rows) // TABLES), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, places = zip(*open_reader(file).toc(), strict=True)
                own = [pa.array([x] * len(names), t) for x, t in ((number, pa.int64()), (file, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *own, pa.array(places, pa.int64())], names=["of", "number", "file", "at"])

    return table.mapInArrow(run, "of string, number long, file string, at long")


def extract_regions(spark: SparkSession, files: list[tuple[str, int]], asked: DataFrame, whole: int) -> DataFrame:
    """Windows of a container of many files: requests (with ``_place`` and ``_part``, by which
    they are dealt) are joined with the names of all files, of equal ones the last; a task
    opens a file once for its requests and decodes a sequence of up to ``whole`` bases once."""
    last = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("number"), F.desc("at")))
    toc = contents(spark, files).withColumn("_last", last).where("_last = 1").drop("_last", "number")
    missing = F.raise_error(F.concat(F.lit('no sequence named "'), "name", F.lit('"'))).cast("long")
    met = asked.join(toc, F.col("name") == F.col("of"), "left").withColumn("at", F.coalesce("at", missing))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(shuffled, "file", "at", "_place", "_part").sortWithinPartitions("file", "at", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, reader, held = None, None, None, None
        for batch in batches:
            bases = []
            for start, end, own, at in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if own != file:
                    file, reader, place = own, open_reader(own), None
                if at != place:
                    place = at
                    held = reader.extract_at(at) if reader.length_at(at) <= whole else None
                bases.append(reader.extract_at(at, start or 0, end) if held is None else held[start or 0 : end])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bases, pa.string())], names=["ordinal", "name", "start", "end", "bases"])

    return dealt.select("ordinal", "name", "start", "end", "file", "at").mapInArrow(run, "ordinal long, name string, start long, end long, bases string")


def entries(reader) -> list[tuple[int, str, int]]:
    """Ordinals in their file, names and places of a file's sequences, in its order."""
    toc = reader.toc()
    if isinstance(reader, TwoBeReader):  # listed by name; places give the file's order
        toc = sorted(toc, key=lambda x: x[1])
    return [(i, n, p) for i, (n, p) in enumerate(toc)]
