"""FASTA and BGZF files that are read in chunks, against plain single-pass versions."""

import os
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.operators.fai import fai_table
from genoframe.sources import chunks
from genoframe.sources.fasta import BGZF_END, bgzf_block, write_indexed_fasta
from genoframe.sources.ranged import MemorySource
from genoframe.sources.readers import bgzf_blocks, scan_fai


def parsed(text: bytes) -> list[tuple[str, str]]:
    """Names and bases, a line at a time."""
    out: list[list] = []
    for raw in text.split(b"\n"):
        line = raw.strip(b" \t\n\f\r")
        if line.startswith(b">"):
            words = line[1:].split(b" ")[0].split(b"\t")[0]
            out.append([words.decode(), ""])
        elif line:
            out[-1][1] += line.decode().translate({ord(c): None for c in " \t\n\f\r"})
    return [tuple(x) for x in out]


def tiles_of(records, tile):
    return sorted((i, n, k // tile, len(b), b[k : k + tile]) for i, (n, b) in enumerate(records) for k in range(0, max(1, len(b)), tile))


TEXTS = [
    b">a d\nACGT\nAC\n>b\n>c\nTT\n", b"\n \n >a x y\r\nAC GT\r\n\r\n>b\n>c\nTT>T\n  >d\nA\n> e\nC", b">only", b">only\n", b">x\n" + b"ACGTN" * 40, b">x\n" + b"ACGTN" * 40 + b"\n>y", b"  \t  \n" * 9 + b"   >z\n" + b" A \n" * 30,
    b">a\n\n\nAC\n", b"", b"\n\n", b">long name " + b"n" * 70 + b"\nAC\nGT\n>" + b"m" * 50 + b"\nA",
]


def random_text(rng):
    line = lambda: "".join(rng.choice("ACGTNacgt  ") for _ in range(rng.randrange(12)))
    parts = []
    for i in range(rng.randrange(1, 9)):
        parts.append(rng.choice(["", " ", "\t"]) + f">r{i}" + rng.choice(["", " more > text", "\tx", " "]))
        parts += [line() for _ in range(rng.randrange(7))]
    return rng.choice(["\n", "\r\n"]).join(parts).encode() + rng.choice([b"", b"\n"])


@pytest.mark.parametrize("chunk", [1, 2, 5, 16, 1000])
def test_records_are_cut_anywhere(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    texts = TEXTS + [random_text(rng) for _ in range(12)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}").write_bytes(text)
    for tile in (4, 64):
        got = {}
        for file, *row in chunks.fasta_tiles(spark, str(tmp_path), tile, chunk).collect():
            got.setdefault(int(os.path.basename(file)[1:]), []).append(tuple(row))
        assert {i: sorted(x) for i, x in got.items()} == {i: t for i, text in enumerate(texts) if (t := tiles_of(parsed(text), tile))}
    # the index counts inner blanks, and a header's line must begin with its mark
    plain = [i for i, text in enumerate(texts) if not any(line.startswith((b" ", b"\t")) for line in text.split(b"\n"))]
    assert len(plain) > 5
    found = {}
    for file, ordinal, *row in chunks.fasta_index(spark, str(tmp_path), chunk).collect():
        found.setdefault(int(os.path.basename(file)[1:]), []).append((ordinal, *row))
    for i in plain:
        assert [r[1:] for r in sorted(found.get(i, []))] == [r for r in scan_fai(texts[i])], texts[i]


def test_data_before_a_header(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"\n AC\n>a\nA\n")
    for chunk in (1, 3, 100):
        with pytest.raises(Exception, match="does not start with"):
            chunks.fasta_tiles(spark, str(tmp_path), 8, chunk).collect()


def packed(text: bytes, rng, stored=0.2) -> bytes:
    """Blocks of various sizes, some empty, some stored as they are."""
    out, at = [], 0
    while at < len(text):
        n = rng.choice([0, 1, 50, 3000, 20_000])
        part = text[at : at + n]
        if rng.random() < stored and len(part) < 0xFF00:
            pack = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = pack.compress(part) + pack.flush()
            out.append(bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", 18 + len(body) + 7) + body + struct.pack("<II", zlib.crc32(part), len(part)))
        else:
            out.append(bgzf_block(part, 1))
        at += n
    return b"".join(out) + BGZF_END


@pytest.mark.parametrize("chunk", [70_000, 100_000, 1 << 22])
def test_blocks_are_found_by_splits(spark, tmp_path, chunk):
    """Payloads hold whole blocks and halves of them, stored so that their bytes stand in the file."""
    rng = random.Random(chunk)
    fake = bgzf_block(b"ACGT" * 40) + bgzf_block(b"A" * 9)
    text = b"".join(rng.choice([fake, fake[:20], fake[5:], os.urandom(50), b"\x1f\x8b\x08\x04", b"plain text " * 30]) for _ in range(9000))
    data = packed(text, rng, 0.9)
    (tmp_path / "x.gz").write_bytes(data)
    want = bgzf_blocks(MemorySource(data))
    assert len(data) > 5 * 70_000 and data.count(b"\x1f\x8b\x08\x04") > 2 * len(want)
    got = sorted(tuple(r)[1:] for r in chunks.bgzf_block_table(spark, str(tmp_path / "x.gz"), chunk).collect())
    assert got == want
    parts = chunks.bgzf_splits(spark, str(tmp_path / "x.gz"), chunk).orderBy("chunk").collect()
    assert b"".join(bytes(chunks.text_of(r["file"], r["start"], r["stop"], True)) for r in parts) == text
    for bad in (data[:-5], data + b"x", data[: len(data) // 2], b"junk" + data):
        (tmp_path / "x.gz").write_bytes(bad)
        with pytest.raises(Exception, match="no BGZF block|cut short"):
            chunks.bgzf_block_table(spark, str(tmp_path / "x.gz"), chunk).collect()


def test_long_records_of_packed_files(spark, tmp_path):
    """One record over many blocks and splits beside short ones, with and without BGZF."""
    rng = random.Random(9)
    rows = [(0, "short", "ACGT" * 5), (1, "long", "".join(rng.choices("ACGTN", k=600_000))), (2, "empty", ""), (3, "last", "".join(rng.choices("acgt", k=90_000)))]
    seqs = spark.createDataFrame(rows, "ordinal long, name string, bases string")
    want = {r[0]: tuple(r)[1:] for r in fai_table(seqs, 70).collect()}
    for name, bgzip in (("x.fa", False), ("x.fa.gz", True)):
        path = str(tmp_path / name)
        write_indexed_fasta(seqs, path, 70, bgzip)
        got = [tuple(r)[1:] for r in chunks.fasta_tiles(spark, path, 1 << 16, 70_000).collect()]
        assert sorted(got) == tiles_of([(n, b) for _, n, b in rows], 1 << 16)
        index = {r["ordinal"]: tuple(r)[2:] for r in chunks.fasta_index(spark, path, 70_000).collect()}
        assert index == want
    parts = chunks.file_chunks(spark, str(tmp_path / "x.fa"), 70_000)
    assert parts.count() == -(-os.path.getsize(tmp_path / "x.fa") // 70_000) and parts.agg(F.max(F.col("stop") - F.col("start"))).first()[0] == 70_000


def test_a_chunk_takes_a_few_times_its_bytes(tmp_path):
    """Whatever the number of chunks, a worker holds what one of them takes."""
    text = b"".join(b">doc%d\n" % i + (b"ACGTNacgtn" * 6 + b"\n") * 25 for i in range(2700))
    text = text[: 4 << 20]
    (tmp_path / "x.fa").write_bytes(text)
    path, n = str(tmp_path / "x.fa"), len(text)
    t = np.frombuffer(text, np.uint8)
    for look in (lambda: chunks.lines_of(t), lambda: chunks.summary_row(path, 0, 0, n, 0, False), lambda: chunks.index_rows(path, 0, n, 0, chunks.BLANKS, 0, False)):
        tracemalloc.start()
        found = look()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6 * n, peak / n
    assert found.num_rows == text.count(b">")


@pytest.mark.parametrize("letters", [b"A>\n", b"AC \n\r\t\f", b" \n", b"A\x0b \n"])
def test_lines_by_their_characters(letters):
    rng = random.Random(len(letters))
    for n in [0, 1, 2, 3, *range(4, 60)]:
        text = bytes(rng.choices(letters, k=n))
        x = chunks.lines_of(np.frombuffer(text, np.uint8))
        plain = [bytes(c for c in line if c not in b" \t\n\f\r") for line in text.split(b"\n")]
        assert (x.count.tolist(), x.first.tolist()) == ([len(p) for p in plain], [p[0] if p else 0 for p in plain])
        assert x.solid.tolist() == [c not in b" \t\n\f\r" for c in text] and x.closed == (b"\n" in text)
