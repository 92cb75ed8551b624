"""Files written and read by Spark, and the commands."""

import gzip
import http.server
import os
import pickle
import random
import threading
from contextlib import contextmanager
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from genoframe import cli
from genoframe.plans.containers import Ranges
from genoframe.sources import containers, fasta
from genoframe.sources import indexed as by_index
from genoframe.sources.batch import ragged
from genoframe.sources.chunks import bgzf_block_table
from genoframe.sources.containers import TwoBeWriter, TwoBitWriter, extract_regions, read_container, write_container
from genoframe.sources.generator import Options, Stream, draws_of, following, generate, long_starts, make, short_starts
from genoframe.sources.readers import bgzf_blocks, indexed_blocks, open_reader

SEQS = [("seqZ", "ACGTNNNryacgtRRRYYYacgtNacgtKMB"), ("seqA", "RRRRRRRRRRacgtACGTNNNN"), ("seqM", "ACGTacgtACGTnnnNNNacgtryswKMB"), ("empty", "")]


@pytest.fixture
def seqs(spark):
    return spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(SEQS)], "ordinal long, name string, bases string").repartition(3)


def rows(df):
    return [(r["name"], r["bases"]) for r in df.orderBy("ordinal").collect()]


@pytest.mark.parametrize("index", ["none", "ptr", "bpt"])
@pytest.mark.parametrize("long", [False, True])
def test_twobit(spark, seqs, tmp_path, index, long):
    path = str(tmp_path / "x.2bit")
    write_container(seqs, path, "twobit", iub=True, long=long, index=index)
    assert os.listdir(tmp_path) == ["x.2bit"]
    back = read_container(spark, path, "twobit", slice=2)
    assert rows(back) == SEQS
    assert rows(back.where("name = 'seqA'")) == [SEQS[1]]
    assert rows(back.where("name IN ('seqM', 'seqZ', 'nope')")) == [SEQS[0], SEQS[2]]


@pytest.mark.parametrize("index", ["none", "ptr", "bpt"])
def test_offsets_widen_where_records_begin_too_far(spark, seqs, tmp_path, monkeypatch, index):
    """A 2-bit file whose records begin beyond what 32 bits place, as those over 4 GiB do."""
    write_container(seqs, str(tmp_path / "short"), "twobit", iub=True, index=index)
    write_container(seqs, str(tmp_path / "long"), "twobit", iub=True, long=True, index=index)
    assert not open_reader(str(tmp_path / "short")).long
    inner = containers.TwoBitWriter(str(tmp_path / "x"), ["name", "bases"], False, True, index)
    monkeypatch.setattr(containers, "SHORT_OFFSETS", 60)
    rows = [(r["name"], r["bases"]) for r in seqs.orderBy("ordinal").collect()]
    encoded = list(inner.encode(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["name", "bases"])))
    head, tail = inner.frame(encoded[0][0], encoded[0][1].sizes)
    assert head + encoded[0][1].data.tobytes() + tail == (tmp_path / "long").read_bytes()


def test_fourbit_and_twobe(spark, seqs, tmp_path):
    write_container(seqs, str(tmp_path / "x.4bit"), "fourbit")
    assert rows(read_container(spark, str(tmp_path / "x.4bit"), "fourbit")) == [(n, b.upper()) for n, b in SEQS]
    write_container(seqs, str(tmp_path / "x.2be"), "twobe")
    assert rows(read_container(spark, str(tmp_path / "x.2be"), "twobe")) == SEQS
    assert open_reader(str(tmp_path / "x.2be")).names() == ["empty", "seqA", "seqM", "seqZ"]


def test_what_a_task_tells_the_driver_does_not_grow_with_its_rows(tmp_path, monkeypatch):
    """Of files without a table of contents the driver needs how many rows and bytes there are."""
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0))
    for writer, columns in ((containers.ConcatenatedWriter, [b"ACGT\n"]), (containers.FourBitWriter, ["seq", "ACGT"])):
        told = []
        for n in (10, 10_000):
            names = ["data"] if len(columns) == 1 else ["name", "bases"]
            batch = pa.RecordBatch.from_arrays([pa.array([c] * n) for c in columns], names=names)
            one = writer(str(tmp_path / "x"), names)
            told.append(one.write(iter([batch, batch])))
            one.commit(told[-1:])
        assert len(pickle.dumps(told[1])) < len(pickle.dumps(told[0])) + 50
        if writer is containers.ConcatenatedWriter:
            assert (tmp_path / "x").read_bytes() == b"ACGT\n" * 20_000
        else:
            assert open_reader(str(tmp_path / "x")).names() == ["seq"] * 20_000


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 250, 300])
def test_parts_are_emptied_as_they_are_copied(tmp_path, monkeypatch, size):
    """A file's bytes take room once, but for a piece; a task that is run again copies what is left."""
    monkeypatch.setattr(containers, "PIECE", 100)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0))
    data = random.Random(size).randbytes(size)
    cut = [data[i : i + 70] for i in range(0, size, 70)]
    batches = [pa.RecordBatch.from_arrays([pa.array([c], pa.binary())], names=["data"]) for c in cut]
    writer = containers.ConcatenatedWriter(str(tmp_path / "x"), ["data"], str(tmp_path / "plan"))
    writer.commit([writer.write(iter(batches))])
    whole, parts, *pieces = (tmp_path / "plan").read_text().splitlines()
    assert sorted(os.path.getsize(f"{parts}/{f}") for f in os.listdir(parts)) == sorted([100] * (size // 100) + [size % 100] * (size % 100 > 0))
    with open(whole, "r+b") as out:
        for done, (at, piece) in enumerate(x.split(" ", 1) for x in pieces):
            for _ in range(2):
                containers.put_piece(out, int(at), piece)
            assert sum(os.path.getsize(f"{parts}/{f}") for f in os.listdir(parts)) == max(0, size - 100 * (done + 1))
    with open(whole, "rb") as out:
        assert out.read() == data
    plain = containers.ConcatenatedWriter(str(tmp_path / "x"), ["data"])
    plain.commit([plain.write(iter(batches))])
    assert (tmp_path / "x").read_bytes() == data


@pytest.mark.parametrize("bgzip", [False, True])
@pytest.mark.parametrize("width", [10, 60, 0])
def test_indexed_fasta(spark, seqs, tmp_path, bgzip, width):
    path = str(tmp_path / "x.fa")
    fasta.write_indexed_fasta(seqs, path, width, bgzip)
    assert sorted(os.listdir(tmp_path)) == ["x.fa", "x.fa.fai"] + ["x.fa.gzi"] * bgzip
    r = open_reader(path)
    for n, b in SEQS:
        assert r.extract(n) == b
        for a in range(0, len(b), 3):
            assert r.extract(n, a, a + 7) == b[a : a + 7]
    by_index = r.fai
    os.remove(path + ".fai")
    scanned = open_reader(path).fai
    assert [s[:3] for s in scanned] == [s[:3] for s in by_index]
    assert rows(read_container(spark, path, "faidx")) == SEQS


def test_bgzf_blocks(spark, tmp_path):
    big = spark.range(3).select(F.col("id").alias("ordinal"), F.concat(F.lit("s"), "id").alias("name"), F.repeat(F.lit("ACGTACGTAC"), 9000).alias("bases"))
    path = str(tmp_path / "big.fa")
    fasta.write_indexed_fasta(big, path, 60, True)
    with gzip.open(path) as f:
        text = f.read()
    assert text.count(b">") == 3 and len(text) == 3 * (4 + 90000 + 1500)
    r = open_reader(path)
    assert r.extract("s1", 60_000, 60_020) == "ACGTACGTACACGTACGTAC"
    with open(path + ".gzi", "rb") as f:
        gzi = f.read()
    blocks = r.text.blocks
    assert blocks == bgzf_blocks(r.text.under) == indexed_blocks(r.text.under, gzi)
    assert int.from_bytes(gzi[:8], "little") == len(blocks) - 1
    assert [int.from_bytes(gzi[8 + 8 * i : 16 + 8 * i], "little") for i in range(2)] == [blocks[1][0], blocks[1][2]]


def test_places_of_pieces_are_summed_without_them(spark):
    """Ranges of 65,536 pieces are summed by their sizes; their bytes pass through no window."""
    pieces = spark.range(50).selectExpr("id AS ordinal", "CAST(repeat('x', CAST(id AS int)) AS binary) AS data")
    made = fasta.bgzf_table(pieces)
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    inputs = [part.split("Input")[1].split("\n")[0] for part in plan.split("\n(") if ") Window" in part.split("\n")[0]]
    assert inputs and not any("data#" in x for x in inputs), inputs
    assert b"".join(gzip.decompress(bytes(r["data"])) for r in made.orderBy("block").collect()) == b"x" * 1225


def test_fasta_scan(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_bytes(b"\n >a d\r\nAC GT\r\n\r\n>b\n>c\nTT>T\n  >d\nA\n> e\nC\n")
    assert rows(fasta.read_fasta(spark, str(p))) == [("a", "ACGT"), ("b", ""), ("c", "TT>T"), ("d", "A"), ("", "C")]
    many = "".join(f">r{i} x\n{'ACGT' * (i % 9)}\n{'NNA' * (i % 5)}\n" for i in range(400))
    p.write_text(many)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
    try:
        got = fasta.read_fasta(spark, str(p))
        assert rows(got) == [(f"r{i}", "ACGT" * (i % 9) + "NNA" * (i % 5)) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    p.write_text("ACGT\n>a\nA\n")
    with pytest.raises(Exception, match="does not start with"):
        fasta.read_fasta(spark, str(p)).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_scanned_index(spark, tmp_path, end):
    from genoframe.sources.readers import scan_fai

    p = tmp_path / "x.fa"
    text = "".join(f">r{i} x{end}" + "".join(f"{'ACGT' * 3}{end}" for _ in range(i % 4)) + (f"AC{end}" if i % 2 else "") for i in range(50))
    p.write_bytes(text.encode())
    (tmp_path / "y.fa").write_bytes(text.replace("ACGT", "GG").encode())
    got = sorted(map(tuple, fasta.scan_fai_table(spark, str(tmp_path)).collect()))
    own = {f: scan_fai((tmp_path / f).read_bytes()) for f in ("x.fa", "y.fa")}
    assert [(os.path.basename(f), *r) for f, *r in got] == sorted((f, *r) for f, rows in own.items() for r in rows)


def test_catalog(spark, seqs, tmp_path):
    for kind in ("twobit", "twobe", "fourbit"):
        write_container(seqs, str(tmp_path / kind), kind)
    fasta.write_fasta(seqs, str(tmp_path / "fasta"))
    fasta.write_indexed_fasta(seqs, str(tmp_path / "bgzf"), 60, True)
    found = {os.path.basename(r["file"]): r["format"] for r in fasta.format_catalog(spark, str(tmp_path)).collect()}
    assert found == {k: k for k in ("twobit", "twobe", "fourbit", "fasta", "bgzf")} | {"bgzf.fai": "unknown", "bgzf.gzi": "unknown"}
    assert [tuple(r)[3:] for r in bgzf_block_table(spark, str(tmp_path / "bgzf")).collect()] == [(0, sum(len(n) + len(b) + 3 for n, b in SEQS))]


def test_read_fai(spark, tmp_path):
    p = tmp_path / "x.fai"
    p.write_text("a\t4\t3\t4\t5\tmore\n\nb\t1\t9\t1\t2\n")
    assert [tuple(r) for r in fasta.read_fai(spark, str(p)).collect()] == [("a", 4, 3, 4, 5), ("b", 1, 9, 1, 2)]
    p.write_text("a\t4\n")
    with pytest.raises(Exception, match="four numbers"):
        fasta.read_fai(spark, str(p)).collect()


def test_stores_are_read_by_uri(seqs, tmp_path):
    """Arrow's file systems, here the local one, give the same bytes."""
    from genoframe.sources.ranged import StoreSource, in_store, list_store
    from genoframe.sources.readers import TwoBeReader

    write_container(seqs, str(tmp_path / "x.2be"), "twobe")
    r = TwoBeReader(StoreSource(f"file://{tmp_path}/x.2be"))
    assert all(r.extract(n, 2, 9) == b[2:9] for n, b in SEQS)
    with pytest.raises(ValueError, match="past the end"):
        r.source.read_at(r.source.size, 1)
    assert list_store(f"file://{tmp_path}") == list_store(f"file://{tmp_path}/x.2be") == [f"file://{tmp_path}/x.2be"]
    assert [in_store(x) for x in ("s3://b/k", "hdfs://h/x", "file:///x", "/x", "http://h/x")] == [True, True, False, False, False]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
def test_indexes_are_read_in_slices(tmp_path, chunk, end):
    """Each task's part of an index, blank lines and all; nothing holds the whole of it."""
    lines = [f"s{i}\t{i}\t9\t5\t6" for i in range(23)]
    (tmp_path / "x").write_text(">s0\n")
    (tmp_path / "x.fai").write_text("\n\n" + "\n \n".join(lines) + end)
    slices = list(containers.index_slices(str(tmp_path / "x"), 5, chunk))
    own = [[n for n, _ in open_reader(str(tmp_path / "x"), (s.low, s.high)).toc()] for s in slices]
    assert [len(x) for x in own] == [5, 5, 5, 5, 3] and sum(own, []) == [f"s{i}" for i in range(23)]
    assert [s.before for s in slices] == [0, 5, 10, 15, 20]


def test_tasks_open_their_part_of_an_index(spark, seqs, tmp_path):
    fasta.write_indexed_fasta(seqs, str(tmp_path / "x"), 10, True)
    reader = containers.ContainerReader("faidx", str(tmp_path / "x"), 2)
    found = [(p, b) for p in reader.partitions() for b in reader.read(p)]
    assert [len(reader.opened(p.file, (p.low, p.high)).fai) for p, _ in found] == [2, 2]
    assert [(r["ordinal"], r["name"], r["bases"]) for _, b in found for r in b.to_pylist()] == [(i, *s) for i, s in enumerate(SEQS)]


def test_missing_index_is_scanned_by_tasks(spark, seqs, tmp_path):
    path = str(tmp_path / "x.fa")
    fasta.write_fasta(seqs, path, 7)
    asked = spark.createDataFrame([(i, n, 2, 12) for i, (n, _) in enumerate(SEQS)], "ordinal long, name string, start long, end long")
    assert [r["bases"] for r in extract_regions(spark, path, asked).orderBy("ordinal").collect()] == [b[2:12] for _, b in SEQS]


def test_requests_beyond_their_sequences_are_dealt_out(spark):
    """Windows without bases don't all go to one task, and neither do those of one place."""
    fai = spark.createDataFrame([(f"s{i}", 100 * i, 50, 50, 51) for i in range(50)], "of string, offset long, length long, linebases long, linewidth long")
    for start in ("id % 40 + 60", "7"):
        asked = spark.range(4000).selectExpr("id AS ordinal", f"concat('s', {'id % 50' if '60' in start else '3'}) AS name", f"CAST({start} AS long) AS start", "CAST(200 AS long) AS end")
        dealt = by_index.by_place(by_index.byte_ranges(asked, fai), 8)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1500, sizes


@pytest.mark.parametrize("indexed", [True, False])
def test_each_block_is_inflated_once(spark, tmp_path, indexed):
    """Requests that repeat, overlap, are empty or reach over ends, of a file of several blocks."""
    from genoframe.sources import indexed as I

    rng = random.Random(3)
    data = [(i, f"s{i}", "".join(rng.choices("ACGTN", k=n))) for i, n in enumerate((90_000, 0, 10, 300_000))]
    path = str(tmp_path / "x.fa")
    fasta.write_indexed_fasta(spark.createDataFrame(data, "ordinal long, name string, bases string"), path, 60, True)
    if not indexed:
        os.remove(path + ".fai")
    bases = {n: b for _, n, b in data}
    asked = [(i, n, s, s + rng.choice([0, 5, 70, 70_000, 10**9])) for i, (n, s) in enumerate((rng.choice(list(bases)), rng.randrange(310_000)) for _ in range(300))] + [(7, "s3", 5, 9)] * 3 + [(900, "s0", 0, None)]
    df = spark.createDataFrame(asked, "ordinal long, name string, start long, end long").repartition(3)
    count = spark.sparkContext.accumulator(0)
    got = sorted((tuple(r) for r in I.extract_regions(spark, path, df, True, count).collect()), key=str)
    assert got == sorted(((i, n, s, e, bases[n][s:e]) for i, n, s, e in asked), key=str)
    assert 0 < count.value <= len(bgzf_blocks(open_reader(path).text.under))
    assert sorted((tuple(r) for r in extract_regions(spark, path, df).collect()), key=str) == got
    with pytest.raises(Exception, match='no sequence named "nope"'):
        extract_regions(spark, path, spark.createDataFrame([(0, "nope", 0, 1)], df.schema)).collect()


def test_hot_names_are_dealt_to_several_tasks(spark, seqs, tmp_path, monkeypatch):
    from genoframe.sources import containers

    monkeypatch.setattr(containers, "HOT", 50)
    asked = spark.range(2000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 10 < 9, "seqM").otherwise("seqA").alias("name"), (F.col("id") % 20).alias("start"), (F.col("id") % 31).alias("end"))
    dealt = containers.with_parts(asked)
    assert dealt.count() == 2000 and dealt.where("name = 'seqM'").select("_part").distinct().count() > 20
    write_container(seqs, str(tmp_path / "x"), "twobe")
    got = extract_regions(spark, str(tmp_path / "x"), asked).orderBy("ordinal").collect()
    bases = dict(SEQS)
    assert [r["bases"] for r in got] == [bases[r["name"]][r["start"] : r["end"]] for r in got] and len(got) == 2000


def test_long_sequences_are_read_by_windows(spark, seqs, tmp_path, monkeypatch):
    """Windows that are decoded apart equal slices of sequences that are decoded whole."""
    from genoframe.sources import containers

    asked = spark.createDataFrame([(10 * i + k, n, a, b) for i, (n, s) in enumerate(SEQS) for k, (a, b) in enumerate([(0, None), (3, 9), (9, 3), (len(s) - 2 if s else 0, 99)])], "ordinal long, name string, start long, end long")
    for kind, whole in (("twobit", SEQS), ("fourbit", [(n, s.upper()) for n, s in SEQS]), ("twobe", SEQS)):
        path = str(tmp_path / kind)
        write_container(seqs, path, kind, **({"iub": True} if kind == "twobit" else {}))
        want = [s[r["start"] : r["end"]] for n, s in whole for r in asked.orderBy("ordinal").collect() if r["name"] == n]
        for limit in (0, 1 << 20):
            monkeypatch.setattr(containers, "WHOLE", max(limit, 1))
            assert [r["bases"] for r in extract_regions(spark, path, asked).orderBy("ordinal").collect()] == want
        with pytest.raises(Exception, match='no sequence named "nope"'):
            extract_regions(spark, path, spark.createDataFrame([(0, "nope", 0, 1)], asked.schema)).collect()


def reference_stream(seed: int, n: int) -> list[int]:
    """SplitMix64 step by step."""
    out, mask = [], 2**64 - 1
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = seed
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return out


def test_generator(spark):
    assert Stream(5).take(6).tolist() == reference_stream(5, 6)
    assert Stream(5, 4).take(2).tolist() == reference_stream(5, 6)[4:]
    for o in (Options(3, 500, 0.05, 0.05, 3), Options(3, 500, 0.05, 0.05, 3, "s", 2, 2), Options(2, 100, 0.1, 0.0, 9, "s", 1, 0)):
        stream = Stream(o.seed)
        whole = [make(stream, o).tobytes().decode() for _ in range(o.seqs)]
        assert [b for _, b in rows(generate(spark, o))] == whole
        if o.n_runs:
            assert all(b.count("N") == round(o.n_frac * o.length) for b in whole)
    first = reference_stream(1, 20)
    assert make(Stream(1), Options(1, 20, 0, 0, 1)).tobytes().decode() == "".join("ACGT"[x % 4] for x in first)


SCATTERED = [Options(700, 40, 0.05, 0.005, 3), Options(900, 7, 0.1, 0.5, 4), Options(500, 5, 0, 1.0, 5), Options(300, 60, 0.1, 0.2, 6, "s", 2), Options(400, 1, 0, 0.4, 7), Options(3, 3000, 0.1, 0.01, 8), Options(4, 2000, 0, 0.9, 9)]


def made(o):
    """Where sequences made one after another start."""
    stream, out = Stream(o.seed), []
    for _ in range(o.seqs):
        out.append(stream.used)
        make(stream, o)
    return out


@pytest.mark.parametrize("o", SCATTERED, ids=str)
def test_starts_of_scattered_codes(spark, o):
    """By spans and by blocks of few numbers, so that there are several levels of them."""
    want = made(o)
    to = following(o, 0, want[-1] + 1)
    assert to[want[:-1]].tolist() == want[1:]
    most = draws_of(o) + o.length
    found = []
    for row in short_starts(spark, o, 2 * most + 11, 4).orderBy("first").collect():
        at = row["used"]
        for i in range(row["first"], row["first"] + row["count"]):
            assert i == len(found)
            found.append(at)
            at = int(to[at]) if at < len(to) else None
    assert found == want
    assert list(long_starts(spark, o, 64)) == want
    assert list(long_starts(spark, o)) == want


def test_sequences_without_bases_or_codes(spark):
    assert rows(generate(spark, Options(3, 0, 0.1, 0.1, 1))) == [("seq0", ""), ("seq1", ""), ("seq2", "")]
    o = Options(600, 20, 0.1, 0.0, 1)
    stream = Stream(o.seed)
    assert [b for _, b in rows(generate(spark, o).orderBy("ordinal"))] == [make(stream, o).tobytes().decode() for _ in range(o.seqs)]


def test_requests_of_a_fetch(tmp_path):
    """A short sequence of a file of 500,000, by a reader that is opened for it: requests and
    bytes stay near what the formats' indexes allow."""
    n = 500_000
    rng = np.random.default_rng(1)
    data = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, n * 300)]
    data[rng.random(n * 300) < 0.005] = ord("R")
    ends = pa.py_buffer((np.arange(n + 1) * 300).astype(np.int32).tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([f"seq{i}" for i in range(n)]), pa.Array.from_buffers(pa.string(), n, [None, ends, pa.py_buffer(data.tobytes())])], names=["name", "bases"])
    with serving(tmp_path) as url:
        for name, writer, requests, kib in (
            ("flat", TwoBitWriter("/x", [], False, False, "none"), 4, 6.7 * 1024), ("ptr", TwoBitWriter("/x", [], False, True, "ptr"), 22, 175),
            ("bpt", TwoBitWriter("/x", [], False, True, "bpt"), 6.6, 54), ("twobe", TwoBeWriter("/x", []), 7, 51),
        ):
            records = [r for _, r in writer.encode(batch)]
            head, tail = writer.frame(ragged(batch.column(0)), np.concatenate([r.sizes for r in records]))
            (tmp_path / name).write_bytes(head + b"".join(r.data.tobytes() for r in records) + tail)
            del records
            used = []
            for i in range(5, n, 33_000):
                r = open_reader(f"{url}/{name}")
                assert r.extract(f"seq{i}").replace("N", "R") == data[i * 300 : (i + 1) * 300].tobytes().decode()
                used.append(r.http_stats())
            assert np.mean(used, axis=0)[0] <= requests and np.mean(used, axis=0)[1] / 1024 <= kib, name
            # a plan of neighbouring records takes a request for many blocks
            r = open_reader(f"{url}/{name}")
            places = [r.find(f"seq{i}") for i in range(0, 3000, 50)]
            before = r.http_stats()[0]
            r.source.prefetch(places)
            assert r.http_stats()[0] - before <= 3
            before = r.http_stats()[0]
            assert all(len(r.extract_at(p)) == 300 for p in places) and r.http_stats()[0] - before <= 6


def test_stretches_of_a_remote_file_take_few_requests(tmp_path, monkeypatch):
    """Tasks that have names in no order of the file fetch each record by itself; those that
    have stretches of it fetch many at once. No server runs here."""
    from genoframe.sources import ranged

    rng = np.random.default_rng(1)
    seqs = {f"s{i}": "".join(rng.choice(list("ACGTNacgtRRyk"), int(n))) for i, n in enumerate(rng.integers(0, 6000, 3000))}
    writer = TwoBeWriter(str(tmp_path / "x"), [])
    batch = pa.RecordBatch.from_arrays([pa.array(list(seqs)), pa.array(list(seqs.values()))], names=["name", "bases"])
    names, records = zip(*writer.encode(batch), strict=True)
    head, tail = writer.frame(ragged(batch.column(0)), np.concatenate([r.sizes for r in records]))
    data = head + b"".join(r.data.tobytes() for r in records) + tail

    class Answered(ranged.HttpSource):
        def _get(self, low, high):
            return data[low:high], {"Content-Range": f"bytes {low}-{high - 1}/{len(data)}"}, self.url

    monkeypatch.setattr(ranged, "HttpSource", Answered)

    def requested(of_task, at) -> int:
        asked = [pa.array(range(len(of_task)), pa.int64()), pa.array(of_task, pa.string()), pa.array([3] * len(of_task), pa.int64()), pa.array([99] * len(of_task), pa.int64()), pa.array(at, pa.int64())]
        used = [Count(), Count()]
        for found in containers.windows_of("http://nowhere/x", used)(iter([pa.RecordBatch.from_arrays(asked, names=["ordinal", "name", "start", "end", "at"])])):
            assert found.column("bases").to_pylist() == [seqs[n][3:99] for n in of_task]
        return used[0].n

    class Count:
        n = 0

        def add(self, n):
            self.n += n

    used = [Count(), Count()]
    (found,) = containers.places_of("http://nowhere/x", used)(iter([pa.RecordBatch.from_arrays([pa.array(sorted(seqs))], names=["name"])]))
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("stretch", "at", "of")), strict=True))
    stretches = [[(n, a) for s, a, n in rows if s == k] for k in sorted({r[0] for r in rows})]
    dealt = sum(requested([n for n, _ in own], [a for _, a in own]) for own in stretches)
    by_name = sum(requested(sorted(seqs)[k :: len(stretches) * 4], [None] * len(sorted(seqs)[k :: len(stretches) * 4])) for k in range(len(stretches) * 4))
    print("requests", dealt, used[0].n, by_name, len(data), len(stretches))
    assert len(stretches) > 5 and dealt < 40 * len(stretches) and used[0].n < 60 and dealt + used[0].n < by_name / 4


def test_failing_requests_are_tried_again(tmp_path, monkeypatch):
    from genoframe.sources import ranged

    monkeypatch.setattr(ranged, "PAUSE", 0.01)
    (tmp_path / "x").write_bytes(bytes(range(256)) * 200)
    faults = []

    class Faulty(Ranges):
        def do_GET(self):  # noqa: N802
            fault = faults.pop(0) if faults else None
            if fault == "busy":
                return self.send_error(503)
            if fault == "short":
                self.send_response(206)
                self.send_header("Content-Range", "bytes 0-9/51200")
                self.send_header("Content-Length", "100")
                self.end_headers()
                self.wfile.write(b"few")
                return None
            if fault == "gone":
                return self.connection.close()
            return super().do_GET()

    with serving(tmp_path, Faulty) as url:
        faults += ["busy", "gone"]
        source = ranged.HttpSource(f"{url}/x", 1000)
        faults += ["short", "busy", "gone"]
        assert source.read_at(5, 3000) == (bytes(range(256)) * 200)[5:3005] and source.requests == 1
        faults += ["busy"] * 4
        with pytest.raises(Exception, match="503"):
            source.read_at(20_000, 10)
        with pytest.raises(Exception, match="404"):
            ranged.HttpSource(f"{url}/y")


@contextmanager
def serving(folder, handler=Ranges):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: handler(*a, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote(spark, seqs, tmp_path):
    write_container(seqs, str(tmp_path / "x.2be"), "twobe")
    write_container(seqs, str(tmp_path / "x.2bit"), "twobit", iub=True, index="bpt")
    fasta.write_indexed_fasta(seqs, str(tmp_path / "x.fa"), 10, True)
    with serving(tmp_path) as base:
        for name in ("x.2be", "x.2bit", "x.fa"):
            url = f"{base}/{name}"
            r = open_reader(url)
            assert r.extract("seqM", 3, 20) == SEQS[2][1][3:20]
            requests, fetched = r.http_stats()
            assert requests >= 1 and fetched >= 1
            asked = spark.createDataFrame([(0, "seqA", 2, 9), (1, "seqA", 2, 9), (2, "seqZ", 0, None)], "ordinal long, name string, start long, end long")
            used = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
            assert [r["bases"] for r in extract_regions(spark, url, asked, used).orderBy("ordinal").collect()] == [SEQS[1][1][2:9]] * 2 + [SEQS[0][1]]
            assert used[0].value >= requests and used[1].value >= fetched


def test_commands(spark, tmp_path, capsys):
    t = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(a), spark)
    run("random", t("r.fa"), "--seqs", "4", "--length", "200", "--seed", "7", "--n-runs", "1")
    run("fa2twobit", t("r.fa"), t("r.2bit"), "--iub", "--bpt", "--index")
    run("twobit2fa", t("r.2bit"), t("r2.fa"))
    run("fa2fourbit", t("r.fa"), t("r.4bit"))
    run("fourbit2fa", t("r.4bit"), t("r3.fa"))
    run("fa2be", t("r.fa"), t("r.2be"))
    run("be2fa", t("r.2be"), t("r4.fa"))
    run("fa2faidx", t("r.fa"), t("r5.fa"), "--bgzip")
    text = (tmp_path / "r.fa").read_bytes()
    assert all((tmp_path / f"r{i}.fa").read_bytes() == text for i in (2, 3, 4))
    capsys.readouterr()
    run("extract", t("r.2bit"), "seq1:5-15", "seq1:5-15", "seq0:190-900")
    out = capsys.readouterr().out
    bases = {n: b for n, b in rows(fasta.read_fasta(spark, t("r.fa")))}
    assert out == f">seq1:5-15\n{bases['seq1'][5:15]}\n" * 2 + f">seq0:190-900\n{bases['seq0'][190:]}\n"
    run("info", t("r.2bit"))
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["# 2-bit, 32-bit offsets, codes kept, index bpt", "name\tlen\tn_blocks\tmask_blocks\tiub_blocks"] and out[2].startswith("seq0\t200\t")
    for name in ("r.2be", "r.4bit", "r5.fa", "r.fa"):
        run("info", t(name))
        assert "# 4 sequences" in capsys.readouterr().out
    with pytest.raises(Exception, match="no sequence named"):
        run("extract", t("r.2bit"), "nope")
    with pytest.raises(Exception, match="bad region"):
        run("extract", t("r.2bit"), "a:-1-2")
    with pytest.raises(SystemExit):
        run("what")
