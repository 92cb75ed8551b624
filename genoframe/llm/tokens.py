"""Token ids as Parquet files: lists of ids in the order of a key, with the metadata to read parts.

Rows are range-partitioned by their key and sorted, then each task encodes its texts and adds
up where each document starts within its shard. Parquet is written by Spark itself: ids by
dictionary, numbers that rise by deltas, pages of PAGE_ROWS rows with indexes, row groups of
ROW_GROUP bytes. Behind the files, their metadata columns alone are read once to write the
table of shards: rows, tokens, first and last key, and the number of tokens before it, which
with a document's place in its shard is its place among all ids.

Reading is a scan that prunes: metadata only reads no ids; keys and spans of ids are filters
on sorted columns, which skip row groups and pages.

Defined results: a null text counts as empty and has the end id only; null keys come first;
rows of one key are ordered by their text's hash, and those that are equal are alike; an empty
table gives files without rows; a key that holds much of the rows is split among tasks by the
hash and the row; columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm.bpe import _tokenizer, read_spec

END_ID = 2
ROW_GROUP = 32 << 20
PAGE_ROWS = 1000
PAGE_BYTES = 1 << 20
#: Rows that are encoded together.
TOGETHER = 500
#: Columns whose values rise or are small: they are kept as deltas.
BY_DELTA = ("key", "start", "stop", "n_tokens")


def encoded(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None) -> DataFrame:
    """``key, shard, start, stop, n_tokens, ids`` in the order of the key: a shard is what a
    task holds, and ``start`` and ``stop`` count within it."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    end = np.array([] if end_id is None else [end_id], np.int32).tobytes()
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["key", "tie", "row"]
    rows = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    names = ["key", "shard", "start", "stop", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, shard, done = _tokenizer(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                coded = [bpe.encode_bytes(t) + end for t in part.column(1).to_pylist()]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                stops = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                stops += done
                done = int(stops[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(stops - sizes), pa.array(stops), pa.array(sizes), lists], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, shard int, start long, stop long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None, row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS) -> str:
    """Write the folders ``tokens`` and ``shards`` under ``path``, which is given back."""
    spark = docs.sparkSession
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group),
        "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": str(page_rows), "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10",
    } | {f"parquet.enable.dictionary#{c}": "false" for c in BY_DELTA}
    encoded(docs, tokenizer_path, key, text, end_id, shards).write.options(**options).parquet(f"{path}/tokens")
    each = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    found, base = [], 0
    for r in each.orderBy("shard").collect():  # a row for each task of the write
        found.append((*r, base))
        base += r["tokens"]
    kind = each.schema["first_key"].dataType.simpleString()
    table = spark.createDataFrame(found, f"shard int, rows long, tokens long, first_key {kind}, last_key {kind}, base long")
    table.coalesce(1).write.parquet(f"{path}/shards")
    return path


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """``shard, rows, tokens, first_key, last_key, base``."""
    return spark.read.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``. What is
    not selected is not read."""
    files, shards = spark.read.parquet(f"{path}/tokens"), shard_table(spark, path)
    joined = files.join(F.broadcast(shards.select(F.col("shard").alias("of"), "base")), F.col("shard") == F.col("of"))
    return joined.select(F.col("key").alias(key), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """As ``read_tokens`` for documents of some keys; other row groups and pages are skipped."""
    return read_tokens(spark, path, key).where(F.col(key).isin(keys))


def read_span(spark: SparkSession, path: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """The ids at places ``low`` to ``high`` of all ids, by document: ``key``, ``start`` and
    ``ids`` of each piece. Shards are chosen by their table, pages by their indexes."""
    files = spark.read.parquet(f"{path}/tokens")
    met = shard_table(spark, path).where((F.col("base") < high) & (F.col("base") + F.col("tokens") > low)).collect()
    pieces = []
    for s in met:
        a, b = max(0, low - s["base"]), min(s["tokens"], high - s["base"])
        inside = files.where((F.col("shard") == s["shard"]) & (F.col("start") < b) & (F.col("stop") > a))
        first = F.greatest(F.lit(a), F.col("start"))
        count = F.least(F.lit(b), F.col("stop")) - first
        pieces.append(inside.select(F.col("key").alias(key), (first + s["base"]).alias("start"), F.slice("ids", (first - F.col("start") + 1).cast("int"), count.cast("int")).alias("ids")))
    found = files.where("false").select(F.col("key").alias(key), "start", "ids") if not pieces else pieces[0]
    for p in pieces[1:]:
        found = found.unionAll(p)
    return found


def with_crc32(tokens: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``ids`` replaced by their unsigned CRC-32, as little-endian unsigned numbers of 32 bits."""
    kept = [c for c in tokens.columns if c != ids]
    schema = tokens.select(kept).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4").data.cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.int64())], names=[*kept, out])

    return tokens.select(*kept, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids)).mapInArrow(run, schema)
