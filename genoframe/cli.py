"""Commands on sequence files: ``python -m genoframe.cli <command>``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators import runs
from genoframe.operators.fai import fasta_text
from genoframe.operators.regions import parse_regions
from genoframe.sources.containers import extract_regions, read_container, write_container
from genoframe.sources.fasta import read_fasta, write_fasta, write_indexed_fasta
from genoframe.sources.generator import Options, generate
from genoframe.sources.indexed import fai_of
from genoframe.sources.ranged import is_url, open_source
from genoframe.sources.readers import Reader, detect, open_reader


def session() -> SparkSession:
    build = SparkSession.builder.appName("genoframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_MASTER" not in os.environ and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
        build = build.master("local[*]")
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Regions of the command line come behind all lines of a list.
BEHIND = 1 << 62


def regions_of(spark: SparkSession, specs: list[str], listed: str | None) -> DataFrame:
    """Regions of a list file, then those named; parsed by tasks."""
    named = spark.createDataFrame(list(enumerate(specs)), "k long, spec string").select((F.col("k") + BEHIND).alias("ordinal"), "spec")
    if listed:
        lines = spark.read.text(listed).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("spec"))
        named = lines.unionByName(named)
    return parse_regions(named)


def extract(spark: SparkSession, path: str, specs: list[str], listed: str | None, used: tuple | None = None) -> DataFrame:
    """The asked-for windows, in the order of the requests, or all sequences. ``used`` are
    accumulators of the tasks' requests and bytes."""
    if specs or listed:
        found = extract_regions(spark, path, regions_of(spark, specs, listed), used)
        name = F.when(F.col("end").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(":"), "start", F.lit("-"), "end"))
        return found.select("ordinal", name.alias("name"), "bases")
    if is_url(path):
        names = [(i, n, 0, None) for i, n in enumerate(open_reader(path).names())]
        whole = spark.createDataFrame(names, "ordinal long, name string, start long, end long")
        return extract_regions(spark, path, whole, used).select("ordinal", "name", "bases")
    source = open_source(path)
    kind = detect(source.read_at(0, min(64, source.size)))
    kind = "faidx" if kind in ("bgzf", "fasta") else kind
    rows = read_container(spark, path, kind)
    # an edit stream's sequences are listed by name
    return rows.select(F.col("name").alias("ordinal") if kind == "twobe" else F.col("ordinal"), "name", "bases")


def show_fasta(rows: DataFrame, out: str | None, width: int) -> None:
    """Written by tasks with ``out``; else printed, a partition of rows at a time."""
    if out:
        return write_fasta(rows, out, width)
    for row in rows.orderBy("ordinal").select(fasta_text(width).alias("text")).toLocalIterator():
        sys.stdout.write(row["text"] + "\n")
    return None


#: What the kinds of files are called.
KINDS = {"twobit": "2-bit", "twobe": "2-bit with edits", "fourbit": "4-bit", "faidx": "indexed FASTA"}


def measured(spark: SparkSession, path: str, reader: Reader) -> DataFrame:
    """Lengths of the sequences that a table of contents lists and, of an edit stream, their
    numbers of edits, read by tasks."""
    with_edits = reader.kind == "twobe"
    places = sorted(reader.toc(), key=lambda x: x[1])
    listed = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(places)], "ordinal long, name string, place long")
    names = ["ordinal", "name", "len"] + ["edits"] * with_edits

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = open_reader(path)
        for batch in batches:
            at = batch.column(2).to_pylist()
            numbers = [[own.length_at(p) for p in at], *([[own.edits_at(p) for p in at]] if with_edits else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(n, pa.int64()) for n in numbers)], names=names)

    return listed.repartitionByRange(spark.sparkContext.defaultParallelism, "place").mapInArrow(look, "ordinal long, name string, len long" + ", edits long" * with_edits)


def info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sequence of a file: its place, name, length and, where the format
    has them, its blocks or edits. The file's own properties are repeated in each."""
    reader = open_reader(path)
    if reader.kind == "twobit":
        rows = runs.twobit_stats(read_container(spark, path, "twobit"))
        about = f"{KINDS['twobit']}, {'64' if reader.long else '32'}-bit offsets, codes {'kept' if reader.iub else 'lost'}, index {reader.index}"
    elif reader.kind == "faidx":
        rows = fai_of(spark, path).select(F.col("offset").alias("ordinal"), F.col("of").alias("name"), F.col("length").alias("len"))
        about = KINDS["faidx"] + (", in BGZF blocks" if reader.bgzf else "")
    else:
        rows, about = measured(spark, path, reader), KINDS[reader.kind]
    return rows.withColumn("format", F.lit(about))


def show_info(spark: SparkSession, path: str) -> None:
    rows = info(spark, path)
    columns = [c for c in rows.columns if c not in ("ordinal", "format")]
    count = 0
    for row in rows.orderBy("ordinal").toLocalIterator():
        if not count:
            print(f"# {row['format']}", "\t".join(columns), sep="\n")
        count += 1
        print(*(row[c] for c in columns), sep="\t")
    print(f"# {count} sequences")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genoframe")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *files: str, width: bool = False):
        s = c.add_parser(name)
        for f in files:
            s.add_argument(f)
        if width:
            s.add_argument("--width", type=int, default=60)
        return s

    s = add("fa2twobit", "source", "target")
    for flag in ("--long", "--iub", "--index", "--bpt"):
        s.add_argument(flag, action="store_true")
    for name in ("twobit2fa", "fourbit2fa", "be2fa"):
        add(name, "source", "target", width=True)
    for name in ("fa2fourbit", "fa2be"):
        add(name, "source", "target")
    s = add("fa2faidx", "source", "target", width=True)
    s.add_argument("--bgzip", action="store_true")
    s.add_argument("--level", type=int, default=6)
    s = add("extract", "source", width=True)
    s.add_argument("regions", nargs="*")
    s.add_argument("--seq-list")
    s.add_argument("--out")
    s.add_argument("--http-stats", action="store_true")
    s = add("random", "target", width=True)
    for flag, kind, default in (("seqs", int, 1), ("length", int, 1_000_000), ("n-frac", float, 0.01), ("iub-frac", float, 0.005), ("seed", int, 1), ("prefix", str, "seq"), ("n-runs", int, 0), ("iub-runs", int, 0)):
        s.add_argument(f"--{flag}", type=kind, default=default)
    add("info", "source")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    spark = spark or session()
    if o.command == "fa2twobit":  # --bpt wins over --index
        write_container(read_fasta(spark, o.source), o.target, "twobit", long=o.long, iub=o.iub, index="bpt" if o.bpt else "ptr" if o.index else "none")
    elif o.command == "fa2fourbit":
        write_container(read_fasta(spark, o.source), o.target, "fourbit")
    elif o.command == "fa2be":
        write_container(read_fasta(spark, o.source), o.target, "twobe")
    elif o.command in ("twobit2fa", "fourbit2fa"):
        write_fasta(read_container(spark, o.source, o.command.removesuffix("2fa")), o.target, o.width)
    elif o.command == "be2fa":  # by name, as its table of contents lists them
        write_fasta(read_container(spark, o.source, "twobe").select(F.col("name").alias("ordinal"), "name", "bases"), o.target, o.width)
    elif o.command == "fa2faidx":
        write_indexed_fasta(read_fasta(spark, o.source), o.target, o.width, o.bgzip, o.level)
    elif o.command == "extract":
        used = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
        show_fasta(extract(spark, o.source, o.regions, o.seq_list, used), o.out, o.width)
        if o.http_stats and is_url(o.source):
            print(f"requests {used[0].value}, bytes {used[1].value}", file=sys.stderr)
    elif o.command == "random":
        write_fasta(generate(spark, Options(o.seqs, o.length, o.n_frac, o.iub_frac, o.seed, o.prefix, o.n_runs, o.iub_runs)), o.target, o.width)
    else:
        show_info(spark, o.source)
    return 0


if __name__ == "__main__":
    sys.exit(main())
