"""FASTA as text: a splittable scan, a writer, indexes, and BGZF blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators.fai import fai_lines, fai_table, fasta_text
from genoframe.operators.regions import TILE, prefix_sums
from genoframe.sources.chunks import fasta_index, fasta_tiles
from genoframe.sources.containers import files_of, write_bytes
from genoframe.sources.ranged import open_source

SPACE = " \\t\\n\\f\\r"
BGZF_CHUNK = 0xFF00
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, first, record``: the text of each record after its ``>``.

    Spark splits files at line starts with ``>``. A record's number is its split's first
    byte plus its place in the split, which is below the next split's first byte, so
    nothing but the splits' first rows is gathered to number all records."""
    text = spark.read.option("lineSep", "\n>").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    begin = text.groupBy("file", "split").agg(F.min("id").alias("low"))
    # a header after blanks does not end a record for the scan, so records are cut again
    cut = text.join(begin, ["file", "split"]).select("file", "split", "id", "low", F.posexplode(F.split("value", r"\n[ \t\f\r]*>")).alias("k", "record"))
    number = F.shiftleft(F.col("split") + F.col("id") - F.col("low"), 20) + F.col("k")
    return cut.select("file", number.alias("ordinal"), ((F.col("split") == 0) & (F.col("id") == F.col("low")) & (F.col("k") == 0)).alias("first"), "record")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, name, bases`` of FASTA files, plain or gzip-compressed.

    ``ordinal`` keeps a file's order; it is not dense. Data before the first header is an
    error when read."""
    cut = _records(spark, path)
    body = F.when(F.col("first"), F.regexp_replace("record", f"^[{SPACE}]*", "")).otherwise(F.concat(F.lit(">"), F.col("record")))
    rows = cut.withColumn("record", body).where("record <> ''")
    bad = F.raise_error(F.concat(F.lit("FASTA does not start with a '>' header: "), "file")).cast("string")
    header = F.regexp_extract("record", "^>([^\\n]*)", 1)
    name = F.regexp_extract(F.regexp_replace(header, f"[{SPACE}]+$", ""), f"^([^{SPACE}]*)", 1)
    name = F.when(F.startswith("record", F.lit(">")), name).otherwise(bad)
    bases = F.regexp_replace(F.regexp_replace("record", "^>[^\\n]*", ""), f"[{SPACE}]", "")
    return rows.select("file", "ordinal", name.alias("name"), bases.alias("bases"))


def fasta_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, name, bases`` of FASTA files, plain or all of them BGZF, from tiles that
    many tasks read: whole rows, for sequences that are to be rows."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "bases"))), lambda x: x["bases"]), "")
    tiles = fasta_tiles(spark, path)
    several = F.col("total") > TILE
    joined = tiles.where(several).groupBy("file", "ordinal", "name").agg(whole.alias("bases"))
    return tiles.where(~several).select("file", "ordinal", "name", "bases").unionAll(joined)


def scan_fai_table(spark: SparkSession, path: str) -> DataFrame:
    """``file, name, length, offset, linebases, linewidth`` of FASTA files without an index,
    found in chunks by many tasks. Carriage returns are not counted as bases."""
    return fasta_index(spark, path).drop("ordinal")


def format_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, format`` of the files of a folder, by their first 64 bytes. Files are
    listed without being read; each task then reads those of a few files."""
    files = files_of(path, sidecars=True)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)), "file")

    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [open_source(file) for file in batch.column(0).to_pylist()]
            heads = pa.array([s.read_at(0, min(64, s.size)) for s in sources], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.size for s in sources], pa.int64()), heads], names=["file", "size", "head"])

    head = F.col("head")
    magic = F.hex(F.substring(head, 1, 4))
    text = F.ltrim(F.regexp_replace(F.decode(head, "ISO-8859-1"), f"^[{SPACE}]+", ""))
    kind = (
        F.when(magic.isin("4327411A", "1A412743"), "twobit").when(magic == "32424531", "twobe").when(magic == "34424954", "fourbit")
        .when((magic == "1F8B0804") & (F.hex(F.substring(head, 13, 2)) == "4243"), "bgzf").when(F.startswith(text, F.lit(">")), "fasta").otherwise("unknown")
    )
    return listed.mapInArrow(peek, "file string, size long, head binary").select("file", "size", kind.alias("format"))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """One FASTA file, in the order of ``ordinal``."""
    line = F.encode(F.concat(fasta_text(width), F.lit("\n")), "UTF-8")
    write_bytes(sequences.select("ordinal", line.alias("data")), path, "data", "ordinal")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """``name, length, offset, linebases, linewidth``; more fields are ignored, fewer are an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("f", F.split("value", "\t"))
    bad = F.raise_error(F.concat(F.lit("an index line without a name and four numbers: "), "value"))
    fields = F.when(F.size("f") >= 5, F.col("f")).otherwise(bad.cast("array<string>"))
    return rows.select(fields[0].alias("name"), *(fields[i].cast("long").alias(c) for i, c in enumerate(("length", "offset", "linebases", "linewidth"), 1)))


# -- BGZF ------------------------------------------------------------------------
def bgzf_block(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 18 + len(body) + 8
    if size > 0x10000:
        raise ValueError("a BGZF block is over 64 KiB")
    return bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf_table(pieces: DataFrame, level: int = 6) -> DataFrame:
    """``block`` and its compressed ``data`` from ``ordinal, data``: bytes that follow one
    another. Each piece is cut where blocks end, so no task needs more than a block. Only sizes
    are summed by ranges of pieces; the pieces themselves meet their places by a hash."""
    sizes = pieces.select("ordinal", F.length("data").cast("long").alias("size"))
    sized = pieces.join(prefix_sums(sizes, "size", out="begin").where("size > 0"), "ordinal")
    span = F.sequence(F.floor(F.col("begin") / BGZF_CHUNK), F.floor((F.col("begin") + F.col("size") - 1) / BGZF_CHUNK))
    cut = sized.withColumn("block", F.explode(span))
    low = F.greatest(F.col("begin"), F.col("block") * BGZF_CHUNK)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BGZF_CHUNK)
    part = F.expr("substring(data, cast(low - begin + 1 AS int), cast(high - low AS int))")
    cut = cut.withColumns({"low": low, "high": high}).select("block", "low", part.alias("part"))

    def compress(rows: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(rows.sort_values("low")["part"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "plain": [len(data)], "data": [bgzf_block(data, level)]})

    return cut.groupBy("block").applyInPandas(compress, "block long, plain long, data binary")


def gzi_table(blocks: DataFrame) -> DataFrame:
    """``compressed_offset, uncompressed_offset`` of every block but the first."""
    sized = blocks.select("block", "plain", F.length("data").cast("long").alias("packed"))
    placed = prefix_sums(prefix_sums(sized, "packed", "block", "compressed_offset"), "plain", "block", "uncompressed_offset")
    return placed.where("block > 0").select("compressed_offset", "uncompressed_offset")


def write_indexed_fasta(sequences: DataFrame, path: str, width: int = 60, bgzip: bool = False, level: int = 6) -> None:
    """Exactly ``path`` and ``path.fai``, and ``path.gzi`` with ``bgzip``. ``ordinal`` must
    count from 0 without gaps."""
    fai = fai_lines(fai_table(sequences, width)).select("ordinal", F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("data"))
    write_bytes(fai, path + ".fai", "data", "ordinal")
    if not bgzip:
        return write_fasta(sequences, path, width)
    text = sequences.select("ordinal", F.encode(F.concat(fasta_text(width), F.lit("\n")), "UTF-8").alias("data"))
    blocks = bgzf_table(text, level).persist()
    end = blocks.sparkSession.createDataFrame([(2**62, bytearray(BGZF_END))], "block long, data binary")
    write_bytes(blocks.select("block", "data").unionByName(end), path, "data", "block")
    gzi = gzi_table(blocks).select("compressed_offset", "uncompressed_offset")
    count = gzi.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([struct.pack("<QQ", *r) for r in rows], pa.binary())], names=["at", "data"])

    head = blocks.sparkSession.createDataFrame([(-1, bytearray(struct.pack("<Q", count)))], "at long, data binary")
    write_bytes(gzi.mapInArrow(pack, "at long, data binary").unionByName(head), path + ".gzi", "data", "at")
    blocks.unpersist()
    return None
