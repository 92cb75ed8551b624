"""Shards that all have the corpus' mixture of sources.

Proportional stratified interleaving: rows are shuffled by a seeded hash and
ranked within their source; a row's fractional rank is its rank over the size of
its source. All rows are sorted by fractional rank and cut into shards whose row
counts differ by one at most, so each shard holds of every source the same share,
give or take a row.

A row's place in the shuffle is the SHA-256 of the seed, its key, its text's digest and its
source, so it doesn't depend on how rows are stored or dealt to tasks. Only rows that are
equal in all of these are told apart by number, and any of them is as good as another.

Ranks come from two range-partitioned sorts. A sort splits a source that holds
much of the rows over many tasks; what joins the tasks' local positions are row
counts by task. Texts are not moved: rows carry their size and checksum only.

Defined results: a null text has size 1 and checksum 0; null sources are a source
of their own; repeated rows get slots of their own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.ranking import positions
from genoframe.llm.scratch import Scratch

SHARDS = 16
SEED = 20_240_601
#: Sources up to which their sizes are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def shuffle_hash(seed: int, key: Column, text: Column, source: Column) -> Column:
    """What orders rows; nulls differ from all texts."""
    parts = (F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in (key, F.sha2(text, 256), source))
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``source``, ``shard`` and gapless ``slot`` of every row."""
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.col(source).cast("string").alias("source"),
        shuffle_hash(seed, F.col(key).cast("string"), F.col(text).cast("string"), F.col(source).cast("string")).alias("h"),
    )
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    ranked = positions(rows, ["source", "h", "row"], "shard-ranks", scratch)
    sizes = ranked.groupBy("source").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = scratch.table(sizes.select(F.col("source").alias("of"), "first", "n"), "shard-sources")
    small = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    ranked = ranked.join(F.broadcast(sizes) if small else sizes, ranked["source"].eqNullSafe(sizes["of"]))
    ranked = ranked.withColumn("fraction", (F.col("pos") - F.col("first") + 0.5) / F.col("n")).drop("pos", "first", "n", "of")
    placed = positions(ranked, ["fraction", "h", "row"], "shard-places", scratch)
    total = rows.count()
    if not total:
        return placed.select(F.col("key").alias(key), "size", "text_crc32", "source", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # shard s starts at ceil(s * total / shards)
    shard = F.expr(f"(pos * {shards}) div {total}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("pos") - start)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "source", F.col("shard").cast("int").alias("shard"), "slot")
