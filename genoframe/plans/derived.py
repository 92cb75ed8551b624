"""Sequences and regions derived from the test tables, which hold no nucleotides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_A_BASE = "[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's letters that are base codes: ``ordinal, name, bases``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), F.regexp_replace("text", NOT_A_BASE, "").alias("bases"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each line item, some beyond the end of their sequence."""
    n = table(spark, sf_dir, "documents").count()
    items = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey").cast("long")
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.concat(F.lit("doc"), F.col("l_orderkey") % n).alias("name"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") * 10).alias("end"),
    )


SEQS = f"""seqs AS (SELECT doc_id AS ordinal, 'doc' || doc_id AS name, regexp_replace(text, '{NOT_A_BASE}', '', 'g') AS bases FROM documents)"""
REGIONS = """regions AS (
  SELECT l_orderkey * 10 + l_linenumber AS ordinal, 'doc' || (l_orderkey % (SELECT count(*) FROM documents)) AS name,
         CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + CAST(l_quantity AS BIGINT) * 10 AS BIGINT) AS e FROM lineitem)"""
#: One row for each base: its sequence, place and letter.
CHARS = """chars AS (SELECT ordinal, name, i - 1 AS p, substr(bases, i, 1) AS c FROM (SELECT ordinal, name, bases, unnest(generate_series(1, length(bases))) AS i FROM seqs))"""


def islands(kind: str, value: str, out: str) -> str:
    """Runs of equal ``value`` (null: none), found letter by letter."""
    return f"""{kind}_v AS (SELECT ordinal, name, p, {value} AS v FROM chars),
{out} AS (SELECT ordinal, name, min(p) AS start, count(*) AS size, v AS code FROM (
  SELECT *, p - row_number() OVER (PARTITION BY ordinal, v ORDER BY p) AS g FROM {kind}_v WHERE v IS NOT NULL) GROUP BY ordinal, name, v, g)"""


N_SQL = islands("n", "CASE WHEN upper(c) NOT IN ('A', 'C', 'G', 'T') THEN 'N' END", "n")
MASK_SQL = islands("m", "CASE WHEN c >= 'a' AND c <= 'z' THEN 'M' END", "m")
IUB_SQL = islands("i", "CASE WHEN strpos('RYSWKMBDHV', upper(c)) > 0 THEN upper(c) END", "i")


def counts_sql(parts: str) -> str:
    """Numbers of a sequence's rows in tables, from ``table:name`` words."""
    return ", ".join(f"(SELECT count(*) FROM {t} WHERE {t}.ordinal = s.ordinal) AS {name}" for t, name in (x.split(":") for x in parts.split()))


STATS_SQL = f"""WITH {SEQS}, {CHARS}, {N_SQL}, {MASK_SQL}, {IUB_SQL}
SELECT s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('n:n_blocks m:mask_blocks i:iub_blocks')} FROM seqs s"""
