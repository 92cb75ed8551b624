"""Containers of many files: in folders and in a store."""

import os

import pytest
from pyarrow import fs
from pyspark.sql.types import LongType, StringType, StructField, StructType

from genoframe.sources import sharded
from genoframe.sources.containers import extract_regions, read_container, write_container, write_shards
from genoframe.sources.readers import open_reader
from tests.store_server import serve, uri

SEQS = [(i * 3, f"s{i % 37}", ("ACGTnnNNRYacgt" * (i % 9))[i % 5 :]) for i in range(60)] + [(500, "", "ACGT"), (501, "empty", ""), (502, "é", "NNNN"), (503, "long", "ACGGT" * 4000)]
KINDS = [("twobit", {"iub": True}), ("twobit", {"iub": True, "index": "ptr"}), ("twobit", {"iub": True, "index": "bpt", "long": True}), ("twobe", {}), ("fourbit", {})]


@pytest.fixture(autouse=True)
def small_batches(spark):
    """A file ends with a batch at the earliest."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def store():
    server = serve()
    yield server
    server.shutdown()


def table(spark, rows=SEQS):
    return spark.createDataFrame(rows, "ordinal long, name string, bases string").repartition(3)


def kept(kind, bases):
    return bases.upper() if kind == "fourbit" else bases


def found(df):
    return sorted((r["ordinal"], r["name"], r["bases"]) for r in df.collect())


def check(spark, path, kind):
    whole = [(i, n, kept(kind, b)) for i, (_, n, b) in enumerate(SEQS)]
    assert found(read_container(spark, path, kind)) == whole
    named = read_container(spark, path, kind).where("name in ('s3', 'long', 'none')")
    assert found(named) == [x for x in whole if x[1] in ("s3", "long")]
    assert sorted(r["name"] for r in read_container(spark, path, kind, ordinals=False).where("name = 's3'").collect()) == ["s3", "s3"]
    asked = [(0, "s3", 2, 9), (1, "long", 19_990, None), (2, "empty", 0, 5), (3, "s36", 0, None), (4, "long", 7, 12), (5, "long", 7, 12), (6, "é", 9, 12)]
    last = {n: b for _, n, b in whole}  # of equal names the last
    got = extract_regions(spark, path, spark.createDataFrame(asked, "ordinal long, name string, start long, end long"))
    assert found(got) == [(i, n, last[n][s:e]) for i, n, s, e in asked]


@pytest.mark.parametrize(("kind", "options"), KINDS)
def test_folder(spark, tmp_path, kind, options):
    path = str(tmp_path / "x")
    write_shards(table(spark), path, kind, file_bytes=300, **options)
    files = sharded.manifest(path)
    assert len(files) > 4 and [at for _, at in files] == sorted({at for _, at in files})
    for file, _ in files:  # each is a container by itself
        assert open_reader(file).kind == kind
    check(spark, path, kind)
    with pytest.raises(Exception, match="manifest already"):
        write_shards(table(spark), path, kind, **options)


@pytest.mark.parametrize(("kind", "options"), [KINDS[2], KINDS[3]])
def test_store(spark, store, kind, options):
    path = uri(store, "bucket/made/x")
    write_container(table(spark), path, kind, file_bytes=300, **options)
    names = [k.rsplit("/", 1)[1] for k in store.objects if k.startswith("bucket/made/x/")]
    assert sharded.MANIFEST in names and len([n for n in names if n.startswith("part-")]) == len(sharded.manifest(path)) > 4
    check(spark, path, kind)


def test_files_of_lost_attempts_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "x")
    write_shards(table(spark), path, "twobit", iub=True, index="ptr")
    first = sharded.manifest(path)[0][0]
    with open(first, "rb") as a, open(f"{os.path.dirname(first)}/part-00000-00000-lost", "wb") as b:
        b.write(a.read())
    check(spark, path, "twobit")


def test_a_failed_write_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "x")
    with pytest.raises(Exception, match="null"):
        write_shards(table(spark, [*SEQS, (900, None, "ACGT")]), path, "twobit")
    assert sharded.manifest(path) is None
    write_shards(table(spark), path, "twobit", iub=True, index="ptr")
    check(spark, path, "twobit")


def test_nothing_and_unknown_names(spark, tmp_path):
    path = str(tmp_path / "x")
    schema = StructType([StructField("ordinal", LongType()), StructField("name", StringType()), StructField("bases", StringType())])
    write_shards(spark.createDataFrame([], schema), path, "twobe")
    assert sharded.manifest(path) == [] and read_container(spark, path, "twobe").count() == 0
    asked = spark.createDataFrame([(0, "x", 0, 1)], "ordinal long, name string, start long, end long")
    with pytest.raises(Exception, match='no sequence named "x"'):
        extract_regions(spark, path, asked).collect()


def test_arrow_reads_the_store(store):
    files, inside = fs.FileSystem.from_uri(uri(store, "bucket/a"))
    with files.open_output_stream(f"{inside}/k") as f:
        f.write(b"0123456789")
    assert files.open_input_file(f"{inside}/k").read_at(3, 4) == b"456"
