"""Queries that write a container, read it back and return what it held, and the
containers' sizes and times on generated sequences."""

from __future__ import annotations

import http.server
import os
import shutil
import tempfile
import threading
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe import cli
from genoframe.plans.derived import REGIONS, SEQS, STATS_SQL, regions, sequences, table
from genoframe.sources.chunks import bgzf_block_table, fasta_tiles
from genoframe.sources.containers import extract_regions, read_container, write_container, write_shards
from genoframe.sources.fasta import format_catalog, read_fai, read_fasta, scan_fai_table, write_fasta, write_indexed_fasta
from genoframe.sources.generator import Options, generate

_folders: list[str] = []
_servers: list[http.server.ThreadingHTTPServer] = []


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that any folder is shared."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def folder(spark: SparkSession) -> str:
    """A folder for written files: under the cluster's shared folder, which must be
    mounted, since containers are written by position; a temporary one where none is set."""
    shared = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    if shared and not os.path.isabs(shared):
        raise ValueError(f"containers need a mounted shared folder, not {shared}")
    if not shared and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if shared:
        os.makedirs(shared, exist_ok=True)
    path = tempfile.mkdtemp(prefix="containers-", dir=shared or None)
    _folders.append(path)
    return path


class Ranges(http.server.SimpleHTTPRequestHandler):
    """Answers requests for a range of a file's bytes."""

    def do_GET(self):  # noqa: N802
        path = self.translate_path(self.path)
        if not os.path.isfile(path):
            return self.send_error(404)
        size = os.path.getsize(path)
        low, high = self.headers["Range"].removeprefix("bytes=").split("-")
        low, high = int(low), min(int(high), size - 1)
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {low}-{high}/{size}")
        self.send_header("Content-Length", str(high + 1 - low))
        self.end_headers()
        with open(path, "rb") as f:
            f.seek(low)
            self.wfile.write(f.read(high + 1 - low))
        return None

    def log_message(self, *args):
        pass


def serve(spark: SparkSession, path: str) -> str:
    """The URL under which the driver's host serves a folder until ``clear``."""
    host = spark.sparkContext.getConf().get("spark.driver.host") or "127.0.0.1"
    server = http.server.ThreadingHTTPServer(("", 0), lambda *a: Ranges(*a, directory=path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _servers.append(server)
    return f"http://{host}:{server.server_port}"


def drop(path: str) -> None:
    """Drop a folder's files, which no result reads any more."""
    _folders.remove(path)
    shutil.rmtree(path)


def clear() -> None:
    """Drop all written files; results that read them can't be used any more."""
    while _servers:
        _servers.pop().shutdown()
    while _folders:
        shutil.rmtree(_folders.pop(), ignore_errors=True)


def _back(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    path = f"{folder(spark)}/x"
    write_container(sequences(spark, sf_dir), path, kind, **options)
    return read_container(spark, path, kind).select("name", F.md5("bases").alias("digest"))


def twobit_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "twobit", index="ptr")


def twobit_iub_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "twobit", iub=True, long=True, index="bpt")


def twobe_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "twobe")


def fourbit_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "fourbit")


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/x.fa"
    write_fasta(sequences(spark, sf_dir), path)
    return read_fasta(spark, path).select("name", F.md5("bases").alias("digest"))


def bgzf_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/x.fa"
    write_indexed_fasta(sequences(spark, sf_dir), path, 60, True)
    return read_container(spark, path, "faidx").select("name", F.md5("bases").alias("digest"))


def _tiled(spark: SparkSession, sf_dir: str, name: str, bgzip: bool) -> DataFrame:
    """Tiles of a file that is read in small chunks, so that records span them."""
    path = f"{folder(spark)}/{name}"
    seqs = sequences(spark, sf_dir)
    if bgzip:
        write_indexed_fasta(seqs, path, 60, True)
    else:
        write_fasta(seqs, path)
    tiles = fasta_tiles(spark, path, 1024, 1 << 17)
    return tiles.select("name", F.col("tile").cast("long").alias("tile"), "total", F.md5("bases").alias("digest"))


def fasta_tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, "x.fa", False)


def bgzf_tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from BGZF blocks that tasks find by themselves."""
    return _tiled(spark, sf_dir, "x.fa.gz", True)


def unindexed_bgzf_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BGZF file without its index, read whole by many tasks."""
    path = f"{folder(spark)}/x.fa"
    write_indexed_fasta(sequences(spark, sf_dir), path, 60, True)
    os.remove(path + ".fai")
    return read_container(spark, path, "faidx").select("name", F.md5("bases").alias("digest"))


# -- windows decoded by seeking ---------------------------------------------------
def _windows(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    path = f"{folder(spark)}/x"
    if kind == "faidx":
        write_indexed_fasta(sequences(spark, sf_dir), path, 60, **options)
    else:
        write_container(sequences(spark, sf_dir), path, kind, **options)
    return extract_regions(spark, path, regions(spark, sf_dir)).select("ordinal", F.md5("bases").alias("digest"))


def twobe_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "twobe")


def twobit_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found by the sorted pointer index."""
    return _windows(spark, sf_dir, "twobit", iub=True, index="ptr")


def twobit_flat_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in the table of contents, codes lost."""
    return _windows(spark, sf_dir, "twobit")


def fourbit_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "fourbit")


def faidx_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "faidx")


def _remote(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    path = folder(spark)
    write_container(sequences(spark, sf_dir), f"{path}/x", kind, **options)
    return extract_regions(spark, f"{serve(spark, path)}/x", regions(spark, sf_dir)).select("ordinal", F.md5("bases").alias("digest"))


def remote_twobit_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By range requests to a server, names found by the tree."""
    return _remote(spark, sf_dir, "twobit", iub=True, index="bpt")


def remote_twobe_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remote(spark, sf_dir, "twobe")


def unindexed_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a plain FASTA file whose index is found by scanning it."""
    path = f"{folder(spark)}/x.fa"
    write_fasta(sequences(spark, sf_dir), path)
    return extract_regions(spark, path, regions(spark, sf_dir)).select("ordinal", F.md5("bases").alias("digest"))


def bgzf_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "faidx", bgzip=True)


def named_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on names that is pushed down: tasks look them up by the container's name tree,
    whose leaves give their ordinals too."""
    path = f"{folder(spark)}/x"
    write_container(sequences(spark, sf_dir), path, "twobit", iub=True, index="bpt")
    found = read_container(spark, path, "twobit").where(F.col("name").isin("doc7", "doc42", "doc99", "none"))
    return found.select("ordinal", "name", F.md5("bases").alias("digest"))


def pointed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the sorted pointers, without ordinals: only pointers and entries on the
    searches' ways are read."""
    path = f"{folder(spark)}/x"
    write_container(sequences(spark, sf_dir), path, "twobit", iub=True, index="ptr")
    found = read_container(spark, path, "twobit", ordinals=False).where(F.col("name").isin("doc7", "doc42", "doc99", "none"))
    return found.select("name", F.md5("bases").alias("digest"))


# -- containers of many files ------------------------------------------------------
def _sharded(spark: SparkSession, sf_dir: str, kind: str, **options) -> str:
    """A folder of containers, of a MiB of records each, so that a task writes several."""
    path = f"{folder(spark)}/x"
    write_shards(sequences(spark, sf_dir), path, kind, file_bytes=1 << 20, **options)
    return path


def sharded_twobit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences, numbered through all files."""
    found = read_container(spark, _sharded(spark, sf_dir, "twobit", iub=True, index="ptr"), "twobit")
    return found.select("ordinal", "name", F.md5("bases").alias("digest"))


def sharded_twobe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_container(spark, _sharded(spark, sf_dir, "twobe"), "twobe")
    return found.select("ordinal", "name", F.md5("bases").alias("digest"))


def sharded_named_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that tasks look up in every file's own tree."""
    found = read_container(spark, _sharded(spark, sf_dir, "twobit", iub=True, index="bpt"), "twobit").where(F.col("name").isin("doc7", "doc42", "doc99", "none"))
    return found.select("ordinal", "name", F.md5("bases").alias("digest"))


def sharded_extract_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of sequences whose files are found by a join with all tables of contents."""
    path = _sharded(spark, sf_dir, "fourbit")
    return extract_regions(spark, path, regions(spark, sf_dir)).select("ordinal", F.md5("bases").alias("digest"))


# -- files as tables ---------------------------------------------------------------
def format_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the files' first bytes; sizes where they follow from the sequences alone.
    A file goes once it has its row or rows, so the largest takes room, not all of them; it is
    written first, before any shuffle files are left by others."""
    seqs = sequences(spark, sf_dir)
    writers = {kind: partial(write_container, kind=kind) for kind in ("twobe", "twobit", "fourbit")}
    writers |= {"fasta": write_fasta, "bgzf": partial(write_indexed_fasta, width=60, bgzip=True)}
    found = []
    for kind, write in writers.items():
        path = folder(spark)
        write(seqs, f"{path}/a.{kind}")
        found += format_catalog(spark, path).collect()
        drop(path)
    name = F.regexp_extract("file", "([^/]+)$", 1)
    size = F.when(F.col("format").isin("fasta", "fourbit"), F.col("size"))
    return spark.createDataFrame(found, "file string, size long, format string").select(name.alias("file"), "format", size.alias("size"))


def scanned_fai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of two FASTA files, found by scanning them."""
    path = folder(spark)
    for k in (0, 1):
        write_fasta(sequences(spark, sf_dir).where(F.col("ordinal") % 2 == k), f"{path}/{k}.fa")
    found = scan_fai_table(spark, path)
    return found.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "name", "length", "offset", "linebases", "linewidth")


def fai_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written index file, read back as a table."""
    path = f"{folder(spark)}/x.fa"
    write_indexed_fasta(sequences(spark, sf_dir), path)
    return read_fai(spark, path + ".fai")


def bgzf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blocks of a BGZF file stand in what they hold."""
    path = f"{folder(spark)}/x.fa"
    write_indexed_fasta(sequences(spark, sf_dir), path, 60, True)
    return bgzf_block_table(spark, path).select("u_start", "u_len")


def random_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated sequence for each document, with scattered N."""
    n = table(spark, sf_dir, "documents").count()
    return generate(spark, Options(n, 200, 0.05, 0.0, 20_240_601, "r"))


def generated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated sequence for each document, with one run of N each."""
    n = table(spark, sf_dir, "documents").count()
    return generate(spark, Options(n, 200, 0.05, 0.0, 20_240_601, "r", n_runs=1))


# -- commands ----------------------------------------------------------------------
def _commanded(spark: SparkSession, sf_dir: str, *commands: str) -> DataFrame:
    """Commands on a FASTA file of all sequences, ``in``, that end in the file ``out``."""
    path = folder(spark)
    write_fasta(sequences(spark, sf_dir), f"{path}/in")
    for command in commands:
        name, *words = command.split()
        cli.main([name, *(w if w.startswith("--") or w.isdigit() else f"{path}/{w}" for w in words)], spark)
    return read_fasta(spark, f"{path}/out").select("name", F.md5("bases").alias("digest"))


def cli_twobit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commanded(spark, sf_dir, "fa2twobit in x --iub --long --index", "twobit2fa x out --width 50")


def cli_fourbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commanded(spark, sf_dir, "fa2fourbit in x", "fourbit2fa x out")


def cli_twobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commanded(spark, sf_dir, "fa2be in x", "be2fa x out")


def cli_faidx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed FASTA in BGZF blocks, all of it extracted."""
    return _commanded(spark, sf_dir, "fa2faidx in x --bgzip --level 1", "extract x --out out")


def cli_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a list, in the order of its lines."""
    path = folder(spark)
    write_container(sequences(spark, sf_dir), f"{path}/x", "twobit", iub=True, index="bpt")
    asked = regions(spark, sf_dir).select(F.concat("name", F.lit(":"), "start", F.lit("-"), "end").alias("value"))
    asked.write.text(f"{path}/list")
    cli.main(["extract", f"{path}/x", "--seq-list", f"{path}/list", "--out", f"{path}/out"], spark)
    return read_fasta(spark, f"{path}/out").select("name", F.md5("bases").alias("digest"))


def cli_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/x"
    write_container(sequences(spark, sf_dir), path, "twobit", iub=True)
    return cli.info(spark, path).select("name", "len", "n_blocks", "mask_blocks", "iub_blocks")


def cli_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = f"{folder(spark)}/out", table(spark, sf_dir, "documents").count()
    cli.main(["random", path, "--seqs", str(n), "--length", "200", "--n-frac", "0.05", "--iub-frac", "0", "--seed", "20240601", "--prefix", "r"], spark)
    return read_fasta(spark, path).select("name", "bases")


def _digest(value: str) -> str:
    return f"WITH {SEQS} SELECT name, md5({value}) AS digest FROM seqs"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        twobit_container_roundtrip, twobit_iub_container_roundtrip, twobe_container_roundtrip, fourbit_container_roundtrip, fasta_roundtrip, bgzf_container_roundtrip,
        twobe_extract_regions, twobit_extract_regions, twobit_flat_extract_regions, fourbit_extract_regions, faidx_extract_regions, bgzf_extract_regions, unindexed_extract_regions, remote_twobit_extract_regions, remote_twobe_extract_regions, generated_runs, fasta_tile_scan, bgzf_tile_scan, unindexed_bgzf_sequences, named_sequences, pointed_sequences,
        sharded_twobit_roundtrip, sharded_twobe_roundtrip, sharded_named_sequences, sharded_extract_regions,
        format_catalogue, scanned_fai, fai_file, bgzf_blocks, random_sequences, cli_twobit, cli_fourbit, cli_twobe, cli_faidx, cli_extract, cli_info, cli_random,
    )
}
_DEGRADED = "regexp_replace(regexp_replace({}, '[^ACGTa-z]', 'N', 'g'), '[bd-fh-su-z]', 'n', 'g')"
_WINDOW = "s.bases[least(r.s, least(r.e, length(s.bases))) + 1 : least(r.e, length(s.bases))]"


def _window_digest(value: str = "{}", key: str = "r.ordinal") -> str:
    return f"WITH {SEQS}, {REGIONS} SELECT {key}, md5({value.format(_WINDOW)}) AS digest FROM regions r JOIN seqs s ON r.name = s.name"


def _numbered(which: str = "") -> str:
    """Sequences by their rank, since documents may be numbered with gaps."""
    return f"WITH {SEQS}, numbered AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, name, md5(bases) AS digest FROM seqs) SELECT * FROM numbered {which}"


_TILES = f"""WITH {SEQS} SELECT name, k AS tile, CAST(length(bases) AS BIGINT) AS total, md5(substr(bases, k * 1024 + 1, 1024)) AS digest
FROM (SELECT *, unnest(generate_series(0, greatest((length(bases) - 1) // 1024, 0))) AS k FROM seqs)"""
_FASTA_BYTES = "strlen(name) + 2 + length(bases) + greatest(CAST(ceil(length(bases) / 60.0) AS BIGINT), 1)"


def _fai(by: str) -> str:
    """The index of a FASTA file of lines of 60, by its records' bytes."""
    return f"""sized AS (SELECT ordinal, name, CAST(length(bases) AS BIGINT) AS length, {_FASTA_BYTES} AS bytes FROM seqs),
fai AS (SELECT *, CAST(coalesce(sum(bytes) OVER ({by} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + strlen(name) + 2 AS "offset" FROM sized)"""


def _mixed(state: str) -> str:
    """SplitMix64's output for a state, in 128-bit arithmetic."""
    z = f"(({state}) % 18446744073709551616::UHUGEINT)"
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        z = f"((xor({z}, {z} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"xor({z}, {z} // {1 << 31}::UHUGEINT)"


def _draw(k: str) -> str:
    return _mixed(f"20240601::UHUGEINT + ({k})::UHUGEINT * 11400714819323198485::UHUGEINT")


#: Of each sequence of 200 bases 200 numbers for letters, 200 for codes, 200 for N.
_RANDOM = f"""WITH places AS (SELECT i, p FROM range((SELECT count(*) FROM documents)) a(i), range(200) b(p)),
made AS (SELECT i, p, CASE WHEN ({_draw("i * 600 + 400 + p + 1")} // 2048::UHUGEINT)::DOUBLE / 9007199254740992 < 0.05 THEN 'N'
  ELSE substr('ACGT', CAST({_draw("i * 600 + p + 1")} % 4::UHUGEINT AS INTEGER) + 1, 1) END AS base FROM places)"""

#: Of each sequence 200 numbers for letters, 200 for codes, and one for the gap before its run of 10.
_RUNS = f"""WITH places AS (SELECT i, p FROM range((SELECT count(*) FROM documents)) a(i), range(200) b(p)),
gaps AS (SELECT i, CAST({_draw("i * 401 + 401")} % 191::UHUGEINT AS BIGINT) AS gap FROM range((SELECT count(*) FROM documents)) a(i)),
made AS (SELECT places.i, p, CASE WHEN p >= gap AND p < gap + 10 THEN 'N' ELSE substr('ACGT', CAST({_draw("places.i * 401 + p + 1")} % 4::UHUGEINT AS INTEGER) + 1, 1) END AS base FROM places JOIN gaps ON gaps.i = places.i)
SELECT i AS ordinal, 'r' || i AS name, string_agg(base, '' ORDER BY p) AS bases FROM made GROUP BY i"""

ORACLES = {
    "twobit_container_roundtrip": _digest(_DEGRADED.format("bases")),
    "twobit_iub_container_roundtrip": _digest("bases"),
    "twobe_container_roundtrip": _digest("bases"),
    "fourbit_container_roundtrip": _digest("upper(bases)"),
    "fasta_roundtrip": _digest("bases"),
    "bgzf_container_roundtrip": _digest("bases"),
    "twobe_extract_regions": _window_digest(),
    "twobit_extract_regions": _window_digest(),
    "twobit_flat_extract_regions": _window_digest(_DEGRADED),
    "fourbit_extract_regions": _window_digest("upper({})"),
    "faidx_extract_regions": _window_digest(),
    "bgzf_extract_regions": _window_digest(),
    "unindexed_extract_regions": _window_digest(),
    "remote_twobit_extract_regions": _window_digest(),
    "remote_twobe_extract_regions": _window_digest(),
    "generated_runs": _RUNS,
    "fasta_tile_scan": _TILES,
    "bgzf_tile_scan": _TILES,
    "unindexed_bgzf_sequences": _digest("bases"),
    "named_sequences": f"WITH {SEQS} SELECT ordinal, name, md5(bases) AS digest FROM seqs WHERE name IN ('doc7', 'doc42', 'doc99')",
    "pointed_sequences": f"WITH {SEQS} SELECT name, md5(bases) AS digest FROM seqs WHERE name IN ('doc7', 'doc42', 'doc99')",
    "sharded_twobit_roundtrip": _numbered(),
    "sharded_twobe_roundtrip": _numbered(),
    "sharded_named_sequences": _numbered("WHERE name IN ('doc7', 'doc42', 'doc99')"),
    "sharded_extract_regions": _window_digest("upper({})"),
    "format_catalogue": f"""WITH {SEQS} SELECT 'a.fasta' AS file, 'fasta' AS format, CAST(sum({_FASTA_BYTES}) AS BIGINT) AS size FROM seqs
UNION ALL SELECT 'a.fourbit', 'fourbit', CAST(16 + sum(9 + strlen(name) + (length(bases) + 1) // 2) AS BIGINT) FROM seqs
UNION ALL VALUES ('a.twobit', 'twobit', NULL), ('a.twobe', 'twobe', NULL), ('a.bgzf', 'bgzf', NULL), ('a.bgzf.fai', 'unknown', NULL), ('a.bgzf.gzi', 'unknown', NULL)""",
    "scanned_fai": f"""WITH {SEQS}, {_fai("PARTITION BY ordinal % 2")} SELECT ordinal % 2 || '.fa' AS file, name, length, "offset", least(60, length) AS linebases, least(60, length) + 1 AS linewidth FROM fai""",
    "fai_file": f"""WITH {SEQS}, {_fai("")} SELECT name, length, "offset", least(60, length) AS linebases, least(60, length) + 1 AS linewidth FROM fai""",
    "bgzf_blocks": f"""WITH {SEQS}, total AS (SELECT CAST(sum({_FASTA_BYTES}) AS BIGINT) AS t FROM seqs)
SELECT k * 65280 AS u_start, least(65280, t - k * 65280) AS u_len FROM (SELECT t, unnest(generate_series(0, (t - 1) // 65280)) AS k FROM total)""",
    "random_sequences": f"{_RANDOM} SELECT i AS ordinal, 'r' || i AS name, string_agg(base, '' ORDER BY p) AS bases FROM made GROUP BY i",
    "cli_twobit": _digest("bases"),
    "cli_fourbit": _digest("upper(bases)"),
    "cli_twobe": _digest("bases"),
    "cli_faidx": _digest("bases"),
    "cli_extract": _window_digest(key="r.name || ':' || r.s || '-' || r.e AS name"),
    "cli_info": STATS_SQL,
    "cli_random": f"{_RANDOM} SELECT 'r' || i AS name, string_agg(base, '' ORDER BY p) AS bases FROM made GROUP BY i",
}


def figures(spark: SparkSession, seqs: int = 500_000, length: int = 300) -> dict[str, dict[str, float]]:
    """Bits a base and seconds to write generated short sequences in each container."""
    made = generate(spark, Options(seqs, length, seed=1, n_runs=1)).persist()
    made.count()
    path = folder(spark)
    out: dict[str, dict[str, float]] = {}
    try:
        for name, kind, options in (
            ("twobit", "twobit", {}), ("twobit_iub_index", "twobit", {"iub": True, "index": "ptr"}), ("twobit_iub_bptree", "twobit", {"iub": True, "index": "bpt"}),
            ("fourbit", "fourbit", {}), ("twobe", "twobe", {}),
        ):
            began = time.perf_counter()
            write_container(made, f"{path}/{name}", kind, **options)
            took = time.perf_counter() - began
            out[name] = {"bits_per_base": round(os.path.getsize(f"{path}/{name}") * 8 / (seqs * length), 3), "write_s": round(took, 3)}
    finally:
        shutil.rmtree(path, ignore_errors=True)
        made.unpersist()
    return out


