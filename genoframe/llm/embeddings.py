"""Near-duplicate vectors by random-hyperplane signs and exact cosines.

Vectors of one label are compared. Each of several tables cuts space by BITS random
hyperplanes; vectors on the same side of all of a table's planes share a bucket, and
within a bucket every cosine is computed in double precision. The number of planes
follows the logarithm of the largest label's size, so that buckets keep their size,
and the number of tables is what finds a pair at the threshold with probability
RECALL.

Vectors are first scaled by a power of two that brings their largest component near 1.
Equal ones are one class then and are compared once. Buckets are dealt into parts of
PART vectors, and each pair of parts is one group of rows, so none is larger than
two parts. Groups first hold the signs only, a bit for each plane of all tables: pairs that
share an earlier table are compared there, and pairs whose signs differ in more planes than
an angle at the threshold would, by six standard deviations, aren't compared. Vectors are
sent to those groups only in which they have a partner left. A group gives counts of links
and a spanning forest of them, not pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label or an id, have no link and are their own
component; vectors of different lengths are not compared; rows that repeat an id
are vectors of their own under one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.components import components
from genoframe.llm.scratch import Scratch

COSINE = 0.93
RECALL = 0.999
BUCKET = 64
PART = 384
SEED = 7
#: Rows up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def plan_tables(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Planes of a table and number of tables for labels of up to so many vectors."""
    bits = max(4, round(math.log2(max(1, rows) / BUCKET)) if rows > BUCKET else 4)
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def usable(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    most = np.abs(v).max()
    if not np.isfinite(v).all() or most == 0:
        return None
    # a power of two changes no cosine and keeps squares from running over or out
    return np.ldexp(v, -int(np.frexp(most)[1]))


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric 0/1 matrix, the first node of its component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1, initial=n)
        after = np.minimum(label, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _by_table(side: np.ndarray, bits: int) -> np.ndarray:
    """A number for the sides of each table's planes, from rows of all planes' sides."""
    return side.reshape(len(side), -1, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _new_pairs(side: np.ndarray, parts: np.ndarray, across: bool, table: int, bits: int) -> np.ndarray:
    """Which pairs of a group are compared in it: those of different parts in a group of
    two, and of them those that share none of the tables before."""
    new = parts[:, None] != parts[None, :] if across else ~np.eye(len(parts), dtype=bool)
    s = _by_table(side, bits)
    for earlier in range(table):
        new &= s[:, None, earlier] != s[None, :, earlier]
    return new


def _by_group(compare, width: int, schema: str):
    """Runs ``compare`` on the rows that share their first ``width`` values and follow one
    another, if they are of two classes or more."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]

    def flushed(rows: list[tuple]) -> pa.RecordBatch:
        found = list(compare(rows)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if held and held[0][:width] != row[:width]:
                    yield flushed(held)
                    held = []
                held.append(row)
        if held:
            yield flushed(held)

    return run


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            raw = []
            for v, one, of in zip(batch.column(2).to_pylist(), ids.to_pylist(), labels.to_pylist(), strict=True):
                u = usable(v) if one is not None and of is not None else None
                raw.append(None if u is None else (u + 0.0).tobytes())
            sums = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(raw, pa.binary()), pa.array(sums, pa.binary())], names=["id", "label", "raw", "sum"])

    rows = scratch.table(rows.mapInArrow(digest, "id long, label string, raw binary, sum binary"), "vectors")
    good = rows.where("raw IS NOT NULL")
    classes = good.groupBy("label", "sum").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    grouped = scratch.table(classes, "classes")
    most = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, cosine)
    # a class is known by its place: ids may repeat
    classes = scratch.table(grouped.withColumn("c", F.monotonically_increasing_id()), "numbered")
    scratch.drop(grouped)

    planes_in_all = bits * tables
    share = math.acos(cosine) / math.pi
    allowed = planes_in_all * share + 6 * math.sqrt(planes_in_all * share * (1 - share))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            packed, sides = [], []
            for raw in batch.column(1).to_pylist():
                v = np.frombuffer(raw)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([SEED, len(v)]).standard_normal((len(v), planes_in_all))
                side = v @ planes[len(v)] > 0
                packed.append(np.packbits(side).tobytes())
                sides.append(_by_table(side[None, :], bits)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sides, pa.list_(pa.int64()))], names=["c", "signs", "sides"])

    signs = classes.select("c", "raw").mapInArrow(sign, "c long, signs binary, sides array<long>")
    signed = scratch.table(classes.join(signs, "c"), "signs")
    sides = signed.select("c", "label", F.octet_length("raw").alias("bytes"), "signs", F.posexplode("sides").alias("t", "side"))
    sides = sides.select("c", "t", "label", "bytes", "signs", F.xxhash64("label", "bytes", "t", "side").alias("bucket"))
    counts = scratch.table(sides.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    # each row goes to all groups that pair its part with another part, or with itself
    dealt = sides.join(_small(counts), "bucket").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("c", "t"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket's hash may stand for two tables, labels or lengths: they are groups of their own
    group = ["bucket", "x", "y", "t", "label", "bytes"]

    def in_groups(rows: DataFrame) -> DataFrame:
        return rows.repartition(shuffled, "bucket", "x", "y").sortWithinPartitions(*group)

    def of_signs(rows: list[tuple]) -> Iterator[tuple]:
        """The rows of a group that have a partner: one that shares no earlier table."""
        _, x, y, t, _, _, _, _, _ = rows[0]
        parts = np.array([r[6] for r in rows])
        side = np.unpackbits(np.array([np.frombuffer(r[8], np.uint8) for r in rows]), axis=1, count=planes_in_all)
        one = side.astype(np.float32) * 2 - 1
        near = planes_in_all - one @ one.T <= 2 * allowed
        near &= _new_pairs(side, parts, x != y, t, bits)
        for i in np.flatnonzero(near.any(1)):
            yield rows[i][:8]

    dealt = dealt.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "t", "label", "bytes", "part", "c", "signs")
    kinds = "bucket long, x int, y int, t int, label string, bytes int, part int, c long"
    paired = scratch.table(in_groups(dealt).mapInArrow(_by_group(of_signs, 6, kinds), kinds), "paired")

    def of_vectors(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """Each class of a group with its number of links and a class it hangs on."""
        _, x, y, t = rows[0][:4]
        parts = np.array([r[6] for r in rows])
        v = np.array([np.frombuffer(r[9]) for r in rows])
        norms = np.sqrt((v * v).sum(1))
        linked = (v @ v.T) / (norms[:, None] * norms[None, :]) >= cosine
        linked &= _new_pairs(np.unpackbits(np.array([np.frombuffer(r[10], np.uint8) for r in rows]), axis=1, count=planes_in_all), parts, x != y, t, bits)
        links, root = linked @ np.array([r[8] for r in rows]), spanning(linked)
        for i in np.flatnonzero((links > 0) | (root != np.arange(len(rows)))):
            yield rows[i][7], int(links[i]), rows[root[i]][7]

    sent = paired.join(signed.select("c", "n", "raw", "signs"), "c").select(*group, "part", "c", "n", "raw", "signs")
    links = "c long, links long, root long"
    found = scratch.table(in_groups(sent).mapInArrow(_by_group(of_vectors, 6, links), links), "links")
    scratch.drop(classes, counts, paired)
    names = signed.select("c", "rep", "n", "label", "sum")
    edges = found.where("c <> root").select("c", "root").distinct()
    edges = edges.join(names.select("c", F.col("rep").alias("a")), "c").join(names.select(F.col("c").alias("root"), F.col("rep").alias("b")), "root")
    joined = components(edges, scratch=scratch)
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    done = names.join(links, "c", "left").join(joined, F.col("rep") == F.col("node"), "left")
    done = scratch.table(done.select("label", "sum", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "results")
    out = rows.select("id", "label", "sum").join(done, ["label", "sum"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
