"""A Merkle manifest of a dataset: leaf digests of rows, subroots of groups, one root, and
the path that proves a row.

A level is a window: nodes are partitioned by their group and their parent's place, and the
list of all of a parent's children, in order, is collected over the whole frame. It is what
the parent's digest is made of, and it gives every child its siblings. Of each parent's rows
the first goes on to the next level, so levels shrink by the fan-out. A partition holds
``fanout`` rows at most, whatever a group's size. Levels are written tables; paths are put
together from the top down by joining each level with the one above it.

Places come from a range-partitioned sort of all rows, so a group that holds much of them is
split over many tasks. Nothing but the root and row counts by task passes through the driver.

All of it is DataFrame operations: no Python runs on rows.

Defined results: fields are taken as text, a null one as ``-``; null groups are a group of
their own and come first; rows of one key are ordered by their leaf, null keys first; equal
rows are leaves of their own, in either order; an empty table gives no rows; columns that are
not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.ranking import positions
from genoframe.llm.scratch import Scratch, collected

FANOUT = 2
#: Rows up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over fields, each with its bytes' number before it."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path, from the leaf to the root and left to right, in one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def build(nodes: DataFrame, most: int, fanout: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Levels, as written tables, and ``g, top`` of each group, from ``g, i, n, h``: a node's
    group, its place, its group's number of nodes (up to ``most``), its digest. Further columns
    stay in the first level."""
    of = Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("g", F.col("h").alias("top"))
    if levels_of(most, fanout) == 0:
        return [scratch.table(nodes.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("parent", "long"), ("before", "string"), ("after", "string"), ("up", "string")))), "level")], tops
    for _ in range(levels_of(most, fanout)):
        rows = nodes.withColumn("parent", F.expr(f"i div {fanout}")).withColumn("run", F.collect_list("h").over(of))
        at = (F.col("i") % fanout).cast("int")
        several = F.col("n") > 1
        rows = rows.withColumns({
            "before": F.when(several, F.array_join(F.slice("run", F.lit(1), at), "")),
            "after": F.when(several, F.array_join(F.slice("run", at + 2, F.lit(fanout)), "")),
            "up": F.when(several, F.sha2(F.array_join("run", ""), 256)),
        }).drop("run")
        level = scratch.table(rows, "level")
        levels.append(level)
        nodes = level.where(f"n > 1 AND i % {fanout} = 0").select("g", F.col("parent").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("up").alias("h"))
        tops = tops.unionAll(nodes.where("n = 1").select("g", F.col("h").alias("top")))
    return levels, tops


def levels_of(n: int, fanout: int) -> int:
    """How often ``n`` nodes are brought together until one is left."""
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def with_paths(levels: list[DataFrame]) -> DataFrame:
    """The first level's rows with ``path``: a step for each level up to their group's top."""
    none = F.array().cast(PATH)
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        rest = none
        if above is not None:
            level = level.join(above, ["g", "parent"], "left")
            rest = F.coalesce("rest", none)
        step = F.when(F.col("up").isNull(), none).otherwise(F.array(F.struct("before", "after")).cast(PATH))
        level = level.withColumn("path", F.concat(step, rest))
        if k == 0:
            return level.drop("rest", "parent", "before", "after", "up")
        above = level.select("g", F.col("i").alias("parent"), F.col("path").alias("rest"))
    raise ValueError("no levels")


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, also: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root`` and ``path`` (siblings before and after, from
    the leaf's level to the root's) of every row. ``also`` are columns of the input to carry."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    extra = {f"x{i}": c for i, c in enumerate((also or {}).values())}
    keep: list[str] = []
    with collected(spark, keep):
        rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("of"), leaf_digest(*(F.col(f) for f in fields)).alias("h"), *(c.alias(x) for x, c in extra.items()), F.monotonically_increasing_id().alias("row"))
        rows = scratch.table(rows, "leaves")
        ranked = positions(rows, ["of", "key", "h", "row"], "ranked", scratch)
        scratch.drop(rows)
        groups = scratch.table(ranked.groupBy("of").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
        # groups in their order, which is that of their first rows
        groups = scratch.table(positions(groups, ["first"], "placed", scratch).select(F.col("of").alias("own"), "first", "n", F.col("pos").alias("g")), "numbered")
        size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
        placed = ranked.join(_small(groups), F.col("of").eqNullSafe(F.col("own")))
        leaves = placed.select("g", (F.col("pos") - F.col("first")).alias("i"), "n", "h", "key", *extra)
        levels, tops = build(leaves, size["most"] or 0, fanout, scratch)
        tops = scratch.table(tops, "subroots")
        upper = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(size["groups"]).cast("long").alias("n"), F.col("top").alias("h"))
        upper, roots = build(upper, size["groups"], fanout, scratch)
        root = roots.select("top").first()
        above = scratch.table(with_paths(upper).select(F.col("i").alias("of"), F.col("h").alias("subroot"), F.col("path").alias("over")), "paths")
        keep += [t._genoframe_path for t in (*levels, above)]
    found = with_paths(levels).join(_small(above), F.col("g") == F.col("of"))
    carried = (F.col(x).alias(n) for x, n in zip(extra, also or {}, strict=True))
    return found.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"), F.concat("path", "over").alias("path"), *carried)
