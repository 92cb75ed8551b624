"""Named queries over the test tables and their DuckDB counterparts.

The counterparts find runs letter by letter, where the queries match segments, so the
two agree only if both are right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions import alphabet as A
from genoframe.operators import fai, regions, runs
from genoframe.plans.derived import CHARS, IUB_SQL, MASK_SQL, N_SQL, REGIONS, SEQS, counts_sql, islands, sequences
from genoframe.plans.derived import regions as item_regions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_VALUE = "CASE WHEN strpos('ACGT', upper(c)) > 0 THEN NULL WHEN strpos('RYSWKMBDHV', upper(c)) > 0 THEN upper(c) ELSE 'N' END"
RUNS = f"WITH {SEQS}, {CHARS}"
EDIT_SQL = islands("b", BASE_VALUE, "b")
ALL_EDITS = f"""{EDIT_SQL}, {MASK_SQL}, edits AS (
  SELECT ordinal, name, start AS pos, size AS len, CASE WHEN code = 'N' THEN 0 WHEN size = 1 THEN 1 ELSE 2 END AS etype, CASE WHEN code = 'N' THEN '' ELSE code END AS code FROM b
  UNION ALL SELECT ordinal, name, start, size, 3, '' FROM m)"""


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# -- sequences as rows -----------------------------------------------------------
@query(f"WITH {SEQS} SELECT count(*) AS sequences, CAST(sum(length(bases)) AS BIGINT) AS bases, CAST(min(length(bases)) AS BIGINT) AS shortest, CAST(max(length(bases)) AS BIGINT) AS longest FROM seqs")
def seq_stats_basic(spark, sf_dir):
    n = A.base_count(F.col("bases"))
    return sequences(spark, sf_dir).agg(F.count(F.lit(1)).alias("sequences"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query(f"WITH {SEQS} SELECT ordinal, name, CAST(length(bases) AS BIGINT) AS len FROM seqs")
def sequence_infos(spark, sf_dir):
    return runs.sequence_infos(sequences(spark, sf_dir))


@query(f"WITH {SEQS} SELECT name FROM seqs ORDER BY name")
def names_sorted(spark, sf_dir):
    return sequences(spark, sf_dir).select("name").orderBy("name")


@query(f"WITH {SEQS} SELECT CAST(max(strlen(name)) AS BIGINT) AS key_size FROM seqs")
def max_name_len(spark, sf_dir):
    return sequences(spark, sf_dir).agg(F.max(F.octet_length("name")).cast("long").alias("key_size"))


@query(f"""WITH {SEQS}, parts AS (SELECT ordinal // 65536 AS part, md5(string_agg(md5(bases), '' ORDER BY ordinal)) AS digest FROM seqs GROUP BY part)
SELECT md5(string_agg(digest, '' ORDER BY part)) AS digest FROM parts""")
def content_digest(spark, sf_dir):
    """One digest of all bases in order: of digests of ranges, of digests of sequences."""
    each = sequences(spark, sf_dir).select("ordinal", F.md5("bases").alias("digest"))
    joined = lambda by: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "digest"))), lambda x: x["digest"]), "")).alias("digest")
    parts = each.groupBy(F.floor(F.col("ordinal") / regions.RANGE).alias("part")).agg(joined("ordinal"))
    return parts.agg(joined("part"))


@query(f"WITH {SEQS} SELECT ordinal, name FROM seqs WHERE ordinal % 7 = 0 ORDER BY ordinal LIMIT 50")
def sampled_names(spark, sf_dir):
    return sequences(spark, sf_dir).where("ordinal % 7 = 0").select("ordinal", "name").orderBy("ordinal").limit(50)


@query(f"""{RUNS} SELECT s.name, count(c) FILTER (strpos('ACGT', upper(c)) > 0) AS plain, count(c) FILTER (strpos('RYSWKMBDHV', upper(c)) > 0) AS iub, count(c) FILTER (upper(c) = 'N') AS n
FROM seqs s LEFT JOIN chars ON chars.ordinal = s.ordinal GROUP BY s.name""")
def base_classes(spark, sf_dir):
    count = lambda pattern: F.length(F.regexp_replace("bases", pattern, "")).cast("long")
    return sequences(spark, sf_dir).select("name", count("[^ACGTacgt]").alias("plain"), count("[^RYSWKMBDHVryswkmbdhv]").alias("iub"), count("[^Nn]").alias("n"))


@query(f"""WITH {SEQS} SELECT name, substr(bases, 1, 1) AS base, CASE WHEN bases = '' THEN NULL WHEN strpos('ACGT', upper(substr(bases, 1, 1))) > 0 THEN 'plain' WHEN strpos('RYSWKMBDHV', upper(substr(bases, 1, 1))) > 0 THEN 'iub' ELSE 'n' END AS class FROM seqs""")
def first_base_class(spark, sf_dir):
    base = F.substring("bases", 1, 1)
    return sequences(spark, sf_dir).select("name", base.alias("base"), F.when(base != "", A.base_class(base)).alias("class"))


@query(f"WITH {SEQS} SELECT name, md5(bases) AS joined FROM seqs")
def strip_lines(spark, sf_dir):
    """Bases that were wrapped, with their line ends taken out again."""
    return sequences(spark, sf_dir).select("name", F.md5(A.strip_line_ends(A.wrap(F.col("bases"), 60))).alias("joined"))


# -- runs ------------------------------------------------------------------------
@query(f"{RUNS}, {N_SQL} SELECT ordinal, name, start, size FROM n")
def n_blocks(spark, sf_dir):
    return runs.n_blocks(sequences(spark, sf_dir))


@query(f"{RUNS}, {MASK_SQL} SELECT ordinal, name, start, size FROM m")
def mask_blocks(spark, sf_dir):
    return runs.mask_blocks(sequences(spark, sf_dir))


@query(f"{RUNS}, {IUB_SQL} SELECT ordinal, name, start, size, code FROM i")
def iub_blocks(spark, sf_dir):
    return runs.iub_blocks(sequences(spark, sf_dir))


@query(f"{RUNS}, {ALL_EDITS} SELECT ordinal, name, pos, len, CAST(etype AS INTEGER) AS etype, code FROM edits")
def edits_2be(spark, sf_dir):
    return runs.edits(sequences(spark, sf_dir))


@query(f"{RUNS}, {ALL_EDITS} SELECT name, count(*) FILTER (etype = 1) AS points, count(*) FILTER (etype = 2) AS code_runs, count(*) FILTER (etype = 0) AS n_runs, CAST(sum(pos) FILTER (etype = 1) AS BIGINT) AS point_places FROM edits GROUP BY name")
def iub_points_vs_runs(spark, sf_dir):
    e = runs.edits(sequences(spark, sf_dir))
    count = lambda k: F.count(F.when(F.col("etype") == k, 1))
    return e.groupBy("name").agg(count(1).alias("points"), count(2).alias("code_runs"), count(0).alias("n_runs"), F.sum(F.when(F.col("etype") == 1, F.col("pos"))).alias("point_places"))


@query(f"""{RUNS}, {ALL_EDITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY pos, etype) - 1 AS place FROM edits)
SELECT ordinal, name, place, pos, len, CAST(etype AS INTEGER) AS etype FROM placed WHERE etype <> 1""")
def run_index(spark, sf_dir):
    return runs.run_index(runs.edits(sequences(spark, sf_dir))).select("ordinal", "name", "place", "pos", "len", "etype")


@query(f"{RUNS}, {N_SQL}, {MASK_SQL}, {IUB_SQL} SELECT s.ordinal, s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('n:n_blocks m:mask_blocks i:iub_blocks')} FROM seqs s")
def twobit_stats(spark, sf_dir):
    return runs.twobit_stats(sequences(spark, sf_dir))


@query(f"{RUNS}, {ALL_EDITS} SELECT s.ordinal, s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('edits:edits')} FROM seqs s")
def twobe_stats(spark, sf_dir):
    return runs.twobe_stats(sequences(spark, sf_dir))


@query(f"""{RUNS}, {N_SQL}, {MASK_SQL}, {IUB_SQL} SELECT ordinal, name, 'N' AS kind, start, size, '' AS code FROM n
UNION ALL SELECT ordinal, name, 'MASK', start, size, '' FROM m UNION ALL SELECT ordinal, name, 'IUB', start, size, code FROM i""")
def tile_blocks(spark, sf_dir):
    """All blocks of sequences that are stored as tiles, joined where tiles cut them."""
    found = runs.tile_blocks(regions.to_tiles(sequences(spark, sf_dir), 1024), 1024)
    return found.select("ordinal", "name", "kind", "start", "size", F.coalesce("code", F.lit("")).alias("code"))


@query(f"{RUNS}, {ALL_EDITS} SELECT ordinal, name, pos, len, CAST(etype AS INTEGER) AS etype, code FROM edits")
def tile_edits(spark, sf_dir):
    """The edit stream of sequences that are stored as tiles."""
    return runs.tile_edits(regions.to_tiles(sequences(spark, sf_dir), 1024), 1024)


@query(f"""{RUNS}, {ALL_EDITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY pos, etype) - 1 AS place FROM edits)
SELECT ordinal, name, place, pos, len, CAST(etype AS INTEGER) AS etype FROM placed WHERE etype <> 1""")
def tile_run_index(spark, sf_dir):
    return runs.tile_index(regions.to_tiles(sequences(spark, sf_dir), 1024), 1024).select("ordinal", "name", "place", "pos", "len", "etype")


@query(f"""WITH {SEQS} SELECT ordinal, name, CAST(k AS BIGINT) AS tile, md5(substr(bases, k * 1024 + 1, 1024)) AS bases
FROM (SELECT *, unnest(generate_series(0, greatest((length(bases) - 1) // 1024, 0))) AS k FROM seqs)""")
def overlay_tiles(spark, sf_dir):
    """Tiles decoded from two bits a base, with all blocks laid over them again."""
    tiles = regions.to_tiles(sequences(spark, sf_dir), 1024)
    blocks = runs.tile_block_lists(tiles, 1024)
    decoded = tiles.withColumn("bases", A.unpack2(A.pack2(F.col("bases")), F.length("bases")))
    return runs.overlay_lists(decoded, *blocks).select("ordinal", "name", "tile", F.md5("bases").alias("bases"))


# -- codecs ----------------------------------------------------------------------
@query(f"""{RUNS}, quads AS (SELECT name, p // 4 AS q, CAST(sum((CASE upper(c) WHEN 'C' THEN 1 WHEN 'A' THEN 2 WHEN 'G' THEN 3 ELSE 0 END) * (1 << CAST(6 - 2 * (p % 4) AS INTEGER))) AS INTEGER) AS b FROM chars GROUP BY name, q)
SELECT s.name, md5(coalesce(string_agg(upper(format('{{:02x}}', b)), '' ORDER BY q), '')) AS packed FROM seqs s LEFT JOIN quads ON s.name = quads.name GROUP BY s.name""")
def pack2_hex(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", F.md5(F.hex(A.pack2(F.col("bases")))).alias("packed"))


@query(f"WITH {SEQS} SELECT name, md5(regexp_replace(upper(bases), '[^ACGT]', 'T', 'g')) AS unpacked FROM seqs")
def unpack2_roundtrip(spark, sf_dir):
    b = F.col("bases")
    return sequences(spark, sf_dir).select("name", F.md5(A.unpack2(A.pack2(b), F.length(b))).alias("unpacked"))


@query(f"WITH {SEQS} SELECT name, md5(rpad(translate(upper(bases), '=ACMGRSVTWYHKDBN', '0123456789ABCDEF'), CAST((length(bases) + 1) // 2 * 2 AS INTEGER), '0')) AS packed FROM seqs")
def pack4_hex(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", F.md5(F.hex(A.pack4(F.col("bases")))).alias("packed"))


@query(f"WITH {SEQS} SELECT name, md5(upper(bases)) AS unpacked FROM seqs")
def unpack4_roundtrip(spark, sf_dir):
    b = F.col("bases")
    return sequences(spark, sf_dir).select("name", F.md5(A.unpack4(A.pack4(b), F.length(b))).alias("unpacked"))


@query(f"WITH {SEQS} SELECT name, md5(regexp_replace(regexp_replace(bases, '[^ACGTa-z]', 'N', 'g'), '[bd-fh-su-z]', 'n', 'g')) AS degraded FROM seqs")
def degrade_standard(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", F.md5(A.degrade(F.col("bases"))).alias("degraded"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^ACGTNRYSWKMBDHVa-z]', 'N', 'g'), '[efijlopquxz]', 'n', 'g')) AS degraded FROM documents")
def degrade_iub(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(A.degrade_iub(F.col("text"))).alias("degraded"))


@query(f"WITH {SEQS} SELECT name, md5(upper(bases)) AS folded FROM seqs")
def fold_upper(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", F.md5(A.fold_upper(F.col("bases"))).alias("folded"))


# -- regions ---------------------------------------------------------------------
@query(f"""WITH {SEQS}, {REGIONS} SELECT r.ordinal, r.name, r.s AS start, r.e AS "end", r.name || ':' || r.s || '-' || r.e AS region,
  s.bases[least(r.s, least(r.e, length(s.bases))) + 1 : least(r.e, length(s.bases))] AS bases FROM regions r JOIN seqs s ON r.name = s.name""")
def extract_regions(spark, sf_dir):
    return regions.extract(sequences(spark, sf_dir), item_regions(spark, sf_dir), unique=True)


@query(f"""WITH {SEQS}, {REGIONS} SELECT r.ordinal, r.name, r.s AS start, r.e AS "end", r.name || ':' || r.s || '-' || r.e AS region,
  s.bases[least(r.s, least(r.e, length(s.bases))) + 1 : least(r.e, length(s.bases))] AS bases FROM regions r JOIN seqs s ON r.name = s.name""")
def extract_from_tiles(spark, sf_dir):
    tiles = regions.to_tiles(sequences(spark, sf_dir), 256)
    # the rows' order must not matter
    return regions.extract_from_tiles(tiles, item_regions(spark, sf_dir).repartition(16), 256)


@query(f"{RUNS}, {N_SQL}, {MASK_SQL}, {IUB_SQL} SELECT s.ordinal, s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('n:n_blocks m:mask_blocks i:iub_blocks')} FROM seqs s")
def tile_stats(spark, sf_dir):
    """Block counts of sequences that are stored as tiles."""
    return runs.tile_stats(regions.to_tiles(sequences(spark, sf_dir), 1024))


@query(f'WITH {SEQS} SELECT ordinal, name, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS "end", name AS region, bases FROM seqs')
def extract_whole(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    wanted = seqs.select("ordinal", "name", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return regions.extract(seqs, wanted)


@query(f"WITH {REGIONS} SELECT ordinal, name || ':' || s || '-' || e AS region FROM regions")
def region_names(spark, sf_dir):
    r = item_regions(spark, sf_dir)
    return r.select("ordinal", A.region_name(F.col("name"), F.col("start"), F.col("end")).alias("region"))


@query(f'WITH {REGIONS} SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN name ELSE \'HLA:\' || name END AS name, CASE WHEN ordinal % 3 = 0 THEN 0 ELSE s END AS start, CASE WHEN ordinal % 3 = 0 THEN NULL ELSE e END AS "end" FROM regions')
def region_parse(spark, sf_dir):
    r = item_regions(spark, sf_dir)
    spec = F.when(F.col("ordinal") % 3 == 0, F.col("name")).otherwise(F.concat(F.lit("HLA:"), "name", F.lit(":"), "start", F.lit("-"), "end"))
    return regions.parse_regions(r.select("ordinal", spec.alias("spec")))


@query(f"""{RUNS}, {N_SQL}, {REGIONS} SELECT r.ordinal, r.name, count(*) AS blocks, CAST(sum(greatest(n.start, r.s) - r.s) AS BIGINT) AS starts, CAST(sum(least(n.start + n.size, r.e) - greatest(n.start, r.s)) AS BIGINT) AS covered
  FROM regions r JOIN n ON r.name = n.name AND n.start < r.e AND n.start + n.size > r.s GROUP BY r.ordinal, r.name""")
def extract_blocks_clipped(spark, sf_dir):
    """Of each region, the blocks that reach into it and the bases they cover there."""
    met = runs.overlapping(item_regions(spark, sf_dir), runs.n_blocks(sequences(spark, sf_dir)).select("name", "start", "size"))
    return met.groupBy("ordinal", "name").agg(F.count(F.lit(1)).alias("blocks"), F.sum("clip_start").alias("starts"), F.sum("clip_size").alias("covered"))


# -- files as tables -------------------------------------------------------------
FAI_SQL = f"""WITH {SEQS}, sized AS (SELECT ordinal, name, CAST(length(bases) AS BIGINT) AS length, strlen(name) + 2 + length(bases) + greatest(CAST(ceil(length(bases) / 60.0) AS BIGINT), 1) AS bytes FROM seqs),
fai AS (SELECT ordinal, name, length, CAST(coalesce(sum(bytes) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + strlen(name) + 2 AS "offset", least(60, length) AS linebases, least(60, length) + 1 AS linewidth FROM sized)"""


@query(f"{FAI_SQL} SELECT * FROM fai")
def fai_table(spark, sf_dir):
    return fai.fai_table(sequences(spark, sf_dir))


@query(f"""{FAI_SQL}, {REGIONS} SELECT r.ordinal, f."offset" + r.s // greatest(f.linebases, 1) * f.linewidth + r.s % greatest(f.linebases, 1) AS at FROM regions r JOIN fai f ON r.name = f.name""")
def fai_offset(spark, sf_dir):
    f = fai.fai_table(sequences(spark, sf_dir)).drop("ordinal")
    r = item_regions(spark, sf_dir).join(f, "name")
    return r.select("ordinal", A.fai_position(F.col("start"), F.col("offset"), F.col("linebases"), F.col("linewidth")).alias("at"))


@query(f"WITH {SEQS} SELECT name, md5('>' || name || chr(10) || rtrim(regexp_replace(bases, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS record FROM seqs")
def wrap_fasta(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", F.md5(fai.fasta_text(60)).alias("record"))


BYTES_SQL = f"""{RUNS}, {N_SQL}, {MASK_SQL}, {IUB_SQL}, stats AS (SELECT s.ordinal, s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('n:n m:mask i:iub')} FROM seqs s),
sized AS (SELECT *, 16 + 8 * n + 8 * mask + (len + 3) // 4 + 4 + 9 * iub AS bytes FROM stats)"""


@query(f"""{BYTES_SQL} SELECT ordinal, name, (SELECT 16 + sum(strlen(name) + 5) FROM seqs)::BIGINT + coalesce(sum(bytes) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sized""")
def record_offsets(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    s = runs.twobit_stats(seqs)
    sized = s.select("ordinal", "name", fai.twobit_record_bytes(F.col("len"), F.col("n_blocks"), F.col("mask_blocks"), F.col("iub_blocks")).alias("bytes"))
    head = seqs.agg((F.sum(F.octet_length("name") + 5) + 16).alias("head"))
    return prefix(sized).crossJoin(F.broadcast(head)).select("ordinal", "name", (F.col("offset") + F.col("head")).alias("offset"))


def prefix(sized: DataFrame) -> DataFrame:
    return regions.prefix_sums(sized, "bytes")


@query(f"""WITH {SEQS}, placed AS (SELECT ordinal, name, 16 + coalesce(sum(strlen(name) + 5) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry FROM seqs)
SELECT name, entry FROM placed ORDER BY name""")
def ptr_order(spark, sf_dir):
    sized = sequences(spark, sf_dir).select("ordinal", "name", (F.octet_length("name") + 5).cast("long").alias("bytes"))
    return prefix(sized).select("name", (F.col("offset") + 16).alias("entry")).orderBy("name")


@query(f"""{RUNS}, {N_SQL}, {MASK_SQL}, {IUB_SQL}, {EDIT_SQL}, stats AS (SELECT s.name, CAST(length(s.bases) AS BIGINT) AS len, {counts_sql('n:n m:mask i:iub')},
  (SELECT count(*) FROM b WHERE b.ordinal = s.ordinal) AS base_edits, (SELECT count(*) FROM b WHERE b.ordinal = s.ordinal AND (b.code = 'N' OR b.size > 1)) AS base_runs FROM seqs s)
SELECT CAST(sum(len) AS BIGINT) AS bases,
  CAST(sum(16 + 8 * n + 8 * mask + (len + 3) // 4) AS BIGINT) AS twobit, CAST(sum(16 + 8 * n + 8 * mask + (len + 3) // 4 + 4 + 9 * iub) AS BIGINT) AS twobit_iub,
  CAST(sum(1 + strlen(name) + 8 + (len + 1) // 2) AS BIGINT) AS fourbit, CAST(sum(12 + 10 * (base_edits + mask) + 4 * (base_runs + mask) + (len + 3) // 4) AS BIGINT) AS twobe,
  CAST(sum(16 + 8 * n + 8 * mask + (len + 3) // 4) * 8 AS DOUBLE) / CAST(sum(len) AS DOUBLE) AS twobit_bits, CAST(sum(1 + strlen(name) + 8 + (len + 1) // 2) * 8 AS DOUBLE) / CAST(sum(len) AS DOUBLE) AS fourbit_bits FROM stats""")
def bits_per_base(spark, sf_dir):
    """Bytes of all records in each format, and bits a base of the two plain ones."""
    seqs = sequences(spark, sf_dir)
    n, e = F.length("bases").cast("long"), runs.N_ONLY
    count = lambda p: F.regexp_count("bases", F.lit(p)).cast("long")
    points = F.regexp_count("bases", F.lit("|".join(f"(?<![{c}{c.lower()}])[{c}{c.lower()}](?![{c}{c.lower()}])" for c in A.IUB_CODES))).cast("long")
    s = seqs.select("name", n.alias("len"), count(runs.N_BLOCKS).alias("n"), count(runs.MASK_BLOCKS).alias("mask"), count(runs.IUB_BLOCKS).alias("iub"), count(e).alias("gaps"), points.alias("points"))
    edits = F.col("gaps") + F.col("iub") + F.col("mask")
    sums = s.agg(
        F.sum("len").alias("bases"),
        F.sum(fai.twobit_record_bytes(F.col("len"), F.col("n"), F.col("mask"))).alias("twobit"),
        F.sum(fai.twobit_record_bytes(F.col("len"), F.col("n"), F.col("mask"), F.col("iub"))).alias("twobit_iub"),
        F.sum(fai.fourbit_record_bytes(F.col("name"), F.col("len"))).alias("fourbit"),
        F.sum(fai.twobe_record_bytes(F.col("len"), edits, edits - F.col("points"))).alias("twobe"),
    )
    bits = {f"{c}_bits": (F.col(c) * 8).cast("double") / F.col("bases").cast("double") for c in ("twobit", "fourbit")}
    return sums.withColumns(bits)
