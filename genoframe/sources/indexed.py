"""Regions of FASTA files by their index as a table, and of BGZF files by their blocks as one.

Requests are joined with the index by name, which gives ranges of bytes. Of a plain file
tasks read these. A BGZF file's ranges are met with its blocks by an equi-join on the 64 KiB
bins that both touch; the pairs are dealt by block, so that each block is read and inflated
once for all requests, and a request's pieces are put together behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from genoframe.functions.alphabet import clamp, fai_position
from genoframe.sources.chunks import BLOCK, bgzf_block_table
from genoframe.sources.containers import has_index
from genoframe.sources.fasta import read_fai, scan_fai_table
from genoframe.sources.ranged import open_source
from genoframe.sources.readers import inflate_block

REQUEST = ["ordinal", "name", "start", "end"]


def fai_of(spark: SparkSession, path: str) -> DataFrame:
    """A file's index, from the file beside it or found by scanning; of equal names the last."""
    fai = read_fai(spark, path + ".fai") if has_index(path) else scan_fai_table(spark, path)
    row = F.struct("offset", "length", "linebases", "linewidth")
    return fai.groupBy("name").agg(F.max(row).alias("row")).select(F.col("name").alias("of"), "row.*")


def byte_ranges(regions: DataFrame, fai: DataFrame) -> DataFrame:
    """Requests, equal ones once with their number ``times``, and the bytes ``low`` to ``high``
    that hold their bases; an unknown name is an error."""
    asked = regions.groupBy(*REQUEST).agg(F.count(F.lit(1)).cast("int").alias("times"))
    rows = asked.join(fai, F.col("name") == F.col("of"), "left")
    missing = F.raise_error(F.concat(F.lit('no sequence named "'), "name", F.lit('"'))).cast("long")
    s, e = clamp(F.col("start"), F.col("end"), F.coalesce("length", missing))
    at = lambda base: fai_position(base, F.col("offset"), F.col("linebases"), F.col("linewidth"))
    rows = rows.withColumns({"s": s, "e": e})
    some = F.col("e") > F.col("s")
    # requests without bases, which may be most, are dealt as their sequences stand
    return rows.select(*REQUEST, "times", F.when(some, at(F.col("s"))).alias("low"), F.when(some, at(F.col("e") - 1) + 1).alias("high"), F.coalesce(F.when(some, at(F.col("s"))), "offset").alias("near"))


def by_place(ranges: DataFrame, tasks: int) -> DataFrame:
    """Ranges dealt by where they stand in the file, those of one place by their requests too."""
    return ranges.repartitionByRange(tasks, "near", "ordinal", "start", "end").sortWithinPartitions("near").drop("near")


def _with(rows: DataFrame, name: str) -> StructType:
    return StructType([*rows.schema.fields, StructField(name, StringType())])


def _repeated(found: DataFrame) -> DataFrame:
    every = found.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return every.select(*REQUEST, F.coalesce("bases", F.lit("")).alias("bases"))


def extract_regions(spark: SparkSession, path: str, regions: DataFrame, packed: bool, inflated=None) -> DataFrame:
    """``ordinal, name, start, end, bases`` of every request. ``inflated`` is an accumulator
    that is added the number of blocks that tasks inflate."""
    ranges = byte_ranges(regions.select(*REQUEST), fai_of(spark, path))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not packed:
        dealt = by_place(ranges, shuffled)
        return _repeated(dealt.mapInArrow(_windows(path), _with(dealt, "bases")))
    ranges = ranges.drop("near")
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / BLOCK), F.floor((high - 1) / BLOCK)))
    blocks = bgzf_block_table(spark, path).select("c_start", "c_len", "u_start", (F.col("u_start") + F.col("u_len")).alias("u_end"))
    blocks = blocks.withColumn("block_bin", bins(F.col("u_start"), F.col("u_end")))
    asked = ranges.where("low IS NOT NULL").withColumn("bin", bins(F.col("low"), F.col("high")))
    met = asked.join(blocks, (F.col("bin") == F.col("block_bin")) & (F.col("u_start") < F.col("high")) & (F.col("u_end") > F.col("low")))
    met = met.where(F.col("bin") == F.floor(F.greatest("u_start", "low") / BLOCK)).select(
        *REQUEST, "times", "c_start", "c_len", "u_start", (F.greatest("u_start", "low") - F.col("u_start")).alias("a"), (F.least("u_end", "high") - F.col("u_start")).alias("b")
    )
    dealt = met.repartition(shuffled, "c_start").sortWithinPartitions("c_start")
    pieces = dealt.mapInArrow(_inflating(path, inflated), _with(dealt, "piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u_start", "piece"))), lambda x: x["piece"]), "")
    found = pieces.groupBy(*REQUEST, "times").agg(whole.alias("bases"))
    empty = ranges.where("low IS NULL").select(*REQUEST, "times", F.lit("").alias("bases"))
    return _repeated(found.unionAll(empty))


def _windows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = open_source(path)
        for batch in batches:
            low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            bases = ["" if a is None else source.read_at(a, b - a).translate(None, b"\r\n").decode("latin-1") for a, b in zip(low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, pa.string())], names=[*batch.schema.names, "bases"])

    return run


def _inflating(path: str, inflated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, known, plain, count = open_source(path), None, b"", 0
        for batch in batches:
            pieces = []
            for at, size, a, b in zip(*(batch.column(c).to_pylist() for c in ("c_start", "c_len", "a", "b")), strict=True):
                if at != known:
                    known, plain, count = at, inflate_block(source.read_at(at, size)), count + 1
                pieces.append(plain[a:b].translate(None, b"\r\n").decode("latin-1"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.string())], names=[*batch.schema.names, "piece"])
        if inflated is not None:
            inflated.add(count)

    return run
