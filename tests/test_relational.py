"""Sequence operators on literal bases, and every query against its counterpart in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from genoframe.functions import alphabet as A
from genoframe.operators import fai, regions, runs
from genoframe.plans import catalogue, containers
from genoframe.sources.fasta import format_catalog

SF = "/root/testdata/sf0.001"


def seqs(spark, *bases):
    return spark.createDataFrame([(i, f"s{i}", b) for i, b in enumerate(bases)], "ordinal long, name string, bases string")


def value(spark, bases, f):
    return seqs(spark, bases).select(f(F.col("bases"))).first()[0]


def test_degrade(spark):
    assert value(spark, "ACGTRYSWKMBDHVNacgtryswn", A.degrade) == "ACGTNNNNNNNNNNNacgtnnnnn"
    assert value(spark, "AC-x*U=", A.degrade) == "ACNnNNN"
    assert value(spark, "ACGTRYSWxXacgtryq-N", A.degrade_iub) == "ACGTRYSWnNacgtrynNN"
    assert value(spark, "AC-x*U=acg", A.nibble_fold) == "ACNNNN=ACG"


@pytest.mark.parametrize("bases", ["", "A", "TCAG", "ACGTA", "ACGT" * 40 + "T", "G" * 32, "T" * 33, "C" * 1000])
def test_packing(spark, bases):
    from genoframe.sources import codec as C
    from tests import plain_codec

    row = seqs(spark, bases).select(A.pack2(F.col("bases")).alias("two"), A.pack4(F.col("bases")).alias("four")).first()
    assert bytes(row["two"]) == plain_codec.pack2(C.as_bytes(bases)) and bytes(row["four"]) == plain_codec.pack4(C.as_bytes(bases))
    n = F.length("bases")
    row = seqs(spark, bases).select(A.unpack2(A.pack2(F.col("bases")), n).alias("two"), A.unpack4(A.pack4(F.col("bases")), n).alias("four")).first()
    assert row["two"] == row["four"] == bases


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs(spark):
    s = seqs(spark, "NRYN", "Rr", "ACGTnnnNNNacgt", "", "AAAA")
    assert found(runs.n_blocks(s), "name", "start", "size") == [("s0", 0, 4), ("s1", 0, 2), ("s2", 4, 6)]
    assert found(runs.iub_blocks(s), "name", "start", "size", "code") == [("s0", 1, 1, "R"), ("s0", 2, 1, "Y"), ("s1", 0, 2, "R")]
    assert found(runs.mask_blocks(s), "name", "start", "size") == [("s1", 1, 1), ("s2", 4, 3), ("s2", 10, 4)]
    assert found(runs.edits(s), "name", "pos", "len", "etype", "code") == [
        ("s0", 0, 1, 0, ""), ("s0", 1, 1, 1, "R"), ("s0", 2, 1, 1, "Y"), ("s0", 3, 1, 0, ""), ("s1", 0, 2, 2, "R"), ("s1", 1, 1, 3, ""),
        ("s2", 4, 3, 3, ""), ("s2", 4, 6, 0, ""), ("s2", 10, 4, 3, ""),
    ]
    assert found(runs.run_index(runs.edits(s)), "name", "place") == [("s0", 0), ("s0", 3), ("s1", 0), ("s1", 1), ("s2", 0), ("s2", 1), ("s2", 2)]
    assert found(runs.twobit_stats(s), "name", "len", "n_blocks", "mask_blocks", "iub_blocks") == [("s0", 4, 1, 0, 2), ("s1", 2, 1, 1, 1), ("s2", 14, 1, 2, 0), ("s3", 0, 0, 0, 0), ("s4", 4, 0, 0, 0)]
    assert found(runs.twobe_stats(s), "name", "edits") == [("s0", 4), ("s1", 2), ("s2", 3), ("s3", 0), ("s4", 0)]
    kinds = runs.blocks(s).groupBy("kind").count()
    assert found(kinds, "kind", "count") == [("IUB", 3), ("MASK", 3), ("N", 3)]
    r = spark.createDataFrame([("s2", 5, 12), ("s4", 0, 4)], "name string, start long, end long")
    assert found(runs.overlapping(r, runs.blocks(s)), "kind", "clip_start", "clip_size") == [("MASK", 0, 2), ("MASK", 5, 2), ("N", 0, 5)]


def test_region_specs(spark):
    specs = ["chr1", " chr1:0-10 ", "", "HLA:A:5-7", "a:+1-2", "x:3-1"]
    df = spark.createDataFrame(list(enumerate(specs)), "ordinal long, spec string")
    assert [tuple(r) for r in regions.parse_regions(df).orderBy("ordinal").collect()] == [(0, "chr1", 0, None), (1, "chr1", 0, 10), (3, "HLA:A", 5, 7), (4, "a", 1, 2), (5, "x", 3, 1)]
    for bad in ("HLA:01", "a:-1-2", "a:1-", "a:"):
        with pytest.raises(Exception, match="bad region"):
            regions.parse_regions(spark.createDataFrame([(0, bad)], "ordinal long, spec string")).collect()


@pytest.mark.parametrize("tiled", [False, True])
def test_extract(spark, tiled):
    s = seqs(spark, "ACGT", "", "ACGTACGTAC")
    asked = [(0, "s0", 5, 3), (1, "s0", 100, 200), (2, "s0", 3, None), (3, "s2", 2, 7), (4, "s2", 2, 7), (5, "s1", 0, None), (6, "s2", 0, 99)]
    r = spark.createDataFrame(asked, "ordinal long, name string, start long, end long")
    get = lambda r: regions.extract_from_tiles(regions.to_tiles(s, 4), r, 4) if tiled else regions.extract(s, r)
    assert [(x["region"], x["bases"]) for x in get(r).orderBy("ordinal").collect()] == [("s0:5-3", ""), ("s0:100-200", ""), ("s0", "T"), ("s2:2-7", "GTACG"), ("s2:2-7", "GTACG"), ("s1", ""), ("s2:0-99", "ACGTACGTAC")]
    with pytest.raises(Exception, match='no sequence named "nope"'):
        get(spark.createDataFrame([(0, "nope", 0, 1)], r.schema)).collect()


def test_last_of_equal_names(spark):
    s = spark.createDataFrame([(0, "a", "AAAA"), (1, "a", "CCCC")], "ordinal long, name string, bases string")
    r = spark.createDataFrame([(0, "a", 0, 2)], "ordinal long, name string, start long, end long")
    assert regions.extract(s, r).first()["bases"] == "CC"


def test_tiles_of_shuffled_regions(spark):
    """Every request gets its own bases, whatever the order of rows."""
    s = seqs(spark, *("".join("ACGT"[(i * j + j // 7) % 4] for j in range(300)) for i in range(1, 40)))
    r = spark.range(4000).select(F.col("id").alias("ordinal"), F.concat(F.lit("s"), F.col("id") % 39).alias("name"), (F.col("id") % 290).alias("start"), (F.col("id") % 290 + F.col("id") % 23).alias("end"))
    want = sorted(map(tuple, regions.extract(s, r, unique=True).collect()))
    got = regions.extract_from_tiles(regions.to_tiles(s, 64), r.repartition(16), 64)
    assert sorted(map(tuple, got.collect())) == want


def test_runs_of_tiles_are_those_of_whole_sequences(spark):
    texts = ["N" * 50, "ACGT" * 5 + "R" * 9 + "nnnn" + "yyYY" * 4 + "ACGTNNN", "RYRYRY" * 4, "", "acgtNNNNNNNNNNNNNNNNNNNNNNNNNNNNNacgt", "A" * 16]
    s = seqs(spark, *texts)
    for tile in (4, 5, 16):
        t = regions.to_tiles(s, tile)
        columns = ("ordinal", "name", "start", "size", "code", "kind")
        assert sorted(found(runs.tile_blocks(t, tile), *columns), key=str) == sorted(found(runs.blocks(s), *columns), key=str)
        assert found(runs.tile_stats(t), "ordinal", "len", "n_blocks", "mask_blocks", "iub_blocks") == found(runs.twobit_stats(s), "ordinal", "len", "n_blocks", "mask_blocks", "iub_blocks")


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
def test_edits_of_tiles(spark, tile):
    """Runs, points that meet at a tile's end, junk of several kinds, and the mask over all."""
    s = seqs(spark, "ACGTNNNryacgtRRRYYYacgtNacgtKMB-*NxnN", "RRRRrrRRRRacgtACGTNNNN", "", "rryyRY", "N-n*", "ACGT" * 20)
    t = regions.to_tiles(s, tile)
    key = lambda df, *c: sorted(map(tuple, df.select("ordinal", *c).collect()))
    columns = ("pos", "len", "etype", "code")
    assert key(runs.tile_edits(t, tile), *columns) == key(runs.edits(s), *columns)
    assert key(runs.tile_run_index(runs.edits(s), tile), "place", "pos", "etype") == key(runs.run_index(runs.edits(s)), "place", "pos", "etype")
    decoded = t.withColumn("bases", A.unpack2(A.pack2(F.col("bases")), F.length("bases")))
    laid = runs.overlay(decoded, runs.tile_blocks(t, tile), tile)
    want = t.select("ordinal", F.col("tile").cast("long").alias("tile"), A.degrade_iub(F.col("bases")).alias("bases"))
    assert laid.columns == t.select("name", "ordinal", "tile", "total", "bases").columns
    assert key(laid, "tile", "bases") == key(want, "tile", "bases")


def test_runs_of_tiles_stay_where_they_are_found(spark):
    """Nothing but what touches a border of two tiles passes through a shuffle."""
    s = spark.range(40).selectExpr("id AS ordinal", "concat('s', id) AS name", "repeat('ACrNnRRyacgtNNb', 20) AS bases")
    t = regions.to_tiles(s, 512)
    for made in (runs.tile_blocks(t, 512), runs.tile_edits(t, 512)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Window [")[0], plan
    # the mask goes on where a tile's first base begins a run of N
    s = s.unionByName(spark.createDataFrame([(99, "m", "acacgtannnacnnaRrracg")], s.schema))
    for tile in (7, 64, 512):
        t = regions.to_tiles(s, tile)
        want = sorted(map(tuple, runs.run_index(runs.edits(s)).select("ordinal", "name", "place", "pos", "len", "etype").collect()))
        assert sorted(map(tuple, runs.tile_index(t, tile).select("ordinal", "name", "place", "pos", "len", "etype").collect())) == want


def test_overlaps_by_bins(spark):
    b = spark.createDataFrame([("c", i * 7, i % 9) for i in range(60)], "name string, start long, size long")
    r = spark.createDataFrame([("c", i * 11, i * 11 + i) for i in range(40)], "name string, start long, end long")
    want = sorted((s, max(x, s) - s, min(x + n, e) - max(x, s)) for _, s, e in map(tuple, r.collect()) for _, x, n in map(tuple, b.collect()) if x < e and x + n > s and n)
    for size in (4, 16, 1 << 17):
        assert found(runs.overlapping(r, b, size), "start", "clip_start", "clip_size") == want


def test_prefix_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(regions, "RANGE", 7)
    df = spark.range(100).select(F.col("id").alias("ordinal"), (F.col("id") % 5).alias("size")).repartition(4)
    want = [sum(i % 5 for i in range(k)) for k in range(100)]
    assert [r["offset"] for r in regions.prefix_sums(df, "size").orderBy("ordinal").collect()] == want
    sparse = df.withColumn("ordinal", F.col("ordinal") * (1 << 40) + 5)
    assert [r["offset"] for r in regions.prefix_sums(sparse, "size").orderBy("ordinal").collect()] == want
    by = df.withColumn("file", F.col("ordinal") % 3)
    got = regions.prefix_sums(by, "size", by="file").orderBy("ordinal").collect()
    assert [r["offset"] for r in got] == [sum(i % 5 for i in range(k) if i % 3 == k % 3) for k in range(100)]
    assert regions.prefix_sums(df.limit(0), "size").count() == 0


@pytest.mark.parametrize("grid", [16, 2048])
def test_ranges_are_balanced(spark, monkeypatch, grid):
    """Clusters and outliers put no more rows into one range than numbers without gaps do."""
    monkeypatch.setattr(regions, "RANGE", 500)
    monkeypatch.setattr(regions, "GRID", grid)
    n = F.col("id")
    for number in (n, n * n, F.when(n == 7, 1 << 60).otherwise(n), (n % 4) * (1 << 33) + n, -n * (1 << 40), F.lit(5).cast("long")):
        df = spark.range(20_000).select(number.alias("ordinal"), (n % 7).alias("size"))
        cuts = regions.quantiles(df, "ordinal")
        each = [r["count"] for r in regions.with_range(df, "ordinal", cuts).groupBy("_range").count().collect()]
        distinct = df.distinct().count() > 7
        assert sum(each) == 20_000 and (max(each) <= 1000 or not distinct)
        if distinct:
            got = regions.prefix_sums(df, "size").orderBy("ordinal").collect()
            at = 0
            for r in got:
                assert r["offset"] == at
                at += r["size"]


@pytest.mark.parametrize("width", [0, 4, 60])
def test_fai(spark, width):
    s = seqs(spark, "ACGTACGTA", "", "AC")
    text = "".join(f">{r['name']}\n{r['t']}\n" for r in s.select("name", A.wrap(F.col("bases"), width).alias("t")).collect())
    for r in fai.fai_table(s, width).join(s.drop("ordinal"), "name").collect():
        per = max(r["linebases"], 1)
        assert "".join(text[r["offset"] + p // per * r["linewidth"] + p % per] for p in range(r["length"])) == r["bases"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES | containers.QUERIES))
def test_query(spark, duck, name):
    got = (catalogue.QUERIES | containers.QUERIES)[name](spark, SF)
    want = duck.sql((catalogue.ORACLES | containers.ORACLES)[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    ours = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert ours == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark):
    """Only the columns a query needs are read, and runs are shuffled as lengths, not bases."""
    plan = catalogue.QUERIES["n_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("Exchange") == 1
    plan = catalogue.QUERIES["twobit_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_catalogued_file_makes_room_for_the_next(spark, monkeypatch):
    """All of them at once would take nine times the documents' room."""
    seen, before = [], list(containers._folders)

    def looked(spark, path):
        assert containers._folders == [*before, path]
        seen.append(sorted(os.listdir(path)))
        return format_catalog(spark, path)

    monkeypatch.setattr(containers, "format_catalog", looked)
    found = containers.QUERIES["format_catalogue"](spark, SF)
    assert seen == [["a.twobe"], ["a.twobit"], ["a.fourbit"], ["a.fasta"], ["a.bgzf", "a.bgzf.fai", "a.bgzf.gzi"]]
    assert containers._folders == before
    assert sorted(r["file"] for r in found.collect()) == sorted(sum(seen, []))
