"""The place of each row in an order of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.scratch import Scratch


def positions(df: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Written rows with ``pos``, their place in the order of all rows.

    A range-partitioned sort; what joins the tasks' local positions are row counts by
    task. ``order`` should end in a column that tells all rows apart, so that no run of
    equal rows is bound to one task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = scratch.table(ranked.withColumn("local", F.monotonically_increasing_id()), name)
    # a task's number stands above bit 33 of its rows' ids
    counts = ranked.groupBy(F.shiftright("local", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    base, total = {}, 0
    for task, rows in sorted((r["task"], r["n"]) for r in counts):
        base[task] = total
        total += rows
    starts = spark.createDataFrame(list(base.items()) or [(0, 0)], "task long, base long")
    joined = ranked.withColumn("task", F.shiftright("local", 33)).join(F.broadcast(starts), "task")
    return joined.withColumn("pos", F.col("base") + F.col("local").bitwiseAND((1 << 33) - 1)).drop("task", "base", "local")
