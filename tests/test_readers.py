"""Containers against hand-derived bytes and against slices of the whole, without Spark's tables."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genoframe.operators.runs import IUB_POINT, IUB_RUN, MASK_RUN, N_RUN
from genoframe.sources import batch as B
from genoframe.sources import codec as C
from genoframe.sources.containers import ContainerReader, FourBitWriter, TwoBeWriter, TwoBitWriter
from genoframe.sources.ranged import MemorySource
from genoframe.sources.readers import FourBitReader, TwoBeReader, TwoBitReader, detect, parse_fai, scan_fai
from tests import plain_codec

F7 = [("c", "ACGTNNNryacgtRRRYYYacgtNacgtKMBacgtACGTnnnNNN"), ("d", "RRRRRRRRRRacgtACGTNNNN")]


def degrade(s: str, iub: bool = False) -> str:
    keep = "ACGTN" + ("RYSWKMBDHV" if iub else "")
    return "".join(c if c.upper() in keep else ("n" if c.islower() else "N") for c in s)


def image(writer, seqs) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([s[i] for s in seqs], pa.string()) for i in (0, 1)], names=["name", "bases"])
    records = [r for _, r in writer.encode(batch)]
    head, tail = writer.frame(B.ragged(batch.column(0)), np.concatenate([np.zeros(0, np.int64), *(r.sizes for r in records)]))
    return head + b"".join(r.data.tobytes() for r in records) + tail


def twobit(seqs, long=False, iub=False, index="none"):
    return image(TwoBitWriter("/x", [], long, iub, index), seqs)


@pytest.mark.parametrize("long", [False, True])
@pytest.mark.parametrize("index", ["none", "ptr", "bpt"])
@pytest.mark.parametrize("iub", [False, True])
def test_twobit_windows(long, iub, index):
    r = TwoBitReader(MemorySource(twobit(F7, long, iub, index)))
    assert (r.long, r.iub, r.index, r.names()) == (long, iub, index, ["c", "d"])
    for name, bases in F7:
        whole = degrade(bases, iub)
        assert r.extract(name) == whole
        for a in range(len(bases) + 1):
            for b in range(a, len(bases) + 2):
                assert r.extract(name, a, b) == whole[a:b]
    with pytest.raises(KeyError, match='no sequence named "nope"'):
        r.extract("nope")


def test_older_readers_see_standard_records():
    data = twobit([("c", "ACGTRYSWacgtN"), ("d", "RRRRGGGG")], iub=True)
    r = TwoBitReader(MemorySource(data[:-8]))
    assert [r.extract(n) for n in r.names()] == ["ACGTNNNNacgtN", "NNNNGGGG"]
    data = twobit([("b", "ACGTRYSW"), ("a", "RRRRGGGG")], iub=True, index="ptr")
    r = TwoBitReader(MemorySource(data[: -24 - 16]))
    assert [r.extract(n) for n in r.names()] == ["ACGTNNNN", "NNNNGGGG"]


def test_twobit_bytes_by_hand():
    # one sequence "a" of ACGTA, its third base masked: header, entry, record
    data = twobit([("a", "ACgTA")])
    record = struct.pack("<IIIIII", 5, 0, 1, 2, 1, 0) + bytes([0x9C, 0x80])
    assert data == struct.pack("<IIII", 0x1A412743, 0, 1, 0) + b"\x01a" + struct.pack("<I", 22) + record


def test_blocks_over_the_end_are_errors():
    data = bytearray(twobit([("a", "NNgt")]))
    assert TwoBitReader(MemorySource(bytes(data))).extract("a") == "NNgt"
    at = 22 + 4 + 4 + 4  # behind the length, the number of N blocks and the block's start
    data[at : at + 4] = struct.pack("<I", 5)
    with pytest.raises(ValueError, match="over the end"):
        TwoBitReader(MemorySource(bytes(data))).extract("a")
    data = bytearray(image(TwoBeWriter("/x", []), [("a", "NNAC")]))
    data[32 + 8 + 4 : 32 + 12 + 4] = struct.pack("<I", 9)
    with pytest.raises(ValueError, match="over the end"):
        TwoBeReader(MemorySource(bytes(data))).extract("a")


def test_long_tables_of_contents_are_read_in_chunks():
    data = twobit([(f"name{i:03d}" * (1 + i % 5), "ACGT") for i in range(300)], long=True)
    whole = TwoBitReader(MemorySource(data)).names()
    r = TwoBitReader(MemorySource(data))
    assert [n for n, _, _ in r._entries(16, r.count, 300)] == whole and len(whole) == 300


def test_big_endian_twobit():
    record = struct.pack(">IIIIIII", 5, 1, 1, 2, 0, 0, 0)[:24] + bytes([0x9C, 0x80])
    record = struct.pack(">I", 5) + struct.pack(">III", 1, 1, 2) + struct.pack(">I", 0) + struct.pack(">I", 0) + bytes([0x9C, 0x80])
    data = struct.pack(">IIII", 0x1A412743, 0, 1, 0) + b"\x01a" + struct.pack(">I", 22) + record
    assert TwoBitReader(MemorySource(data)).extract("a") == "ANNTA"


@pytest.mark.parametrize("kind", ["twobit", "twobe"])
def test_many_names_need_inner_tree_nodes(kind):
    seqs = [(f"seq{i:04d}", "ACGT" + "ACG" * (i % 7 + 1) + "NNNacgtRY") for i in range(600)]
    r = TwoBeReader(MemorySource(image(TwoBeWriter("/x", []), seqs))) if kind == "twobe" else TwoBitReader(MemorySource(twobit(seqs, iub=True, index="bpt")))
    assert r.names() == [n for n, _ in seqs]
    assert all(r.extract(n) == b for n, b in seqs)
    assert r.find("seq9999") is None and r.find("s" * 300) is None and r.find("") is None


def test_twobe_windows_and_edits():
    bases = "ACGTNNNNNNNNacgtRYSWWWKMacgtRRRRRACGT"
    r = TwoBeReader(MemorySource(image(TwoBeWriter("/x", []), [("mix", bases)])))
    for a in range(len(bases) + 1):
        for b in range(a, len(bases) + 1):
            assert r.extract("mix", a, b) == bases[a:b]
    kinds = [tuple(e)[:3] for e in plain_codec.edits_of(C.as_bytes("NRYN"))]
    assert kinds == [(0, 1, N_RUN), (1, 1, IUB_POINT), (2, 1, IUB_POINT), (3, 1, N_RUN)]
    assert [tuple(e)[:3] for e in plain_codec.edits_of(C.as_bytes("Rr"))] == [(0, 2, IUB_RUN), (1, 1, MASK_RUN)]


def test_fourbit():
    r = FourBitReader(MemorySource(image(FourBitWriter("/x", []), [("c", "acgtryswn"), ("d", "ACGTA"), ("e", "AC-x*U=")])))
    assert [r.extract(n) for n in r.names()] == ["ACGTRYSWN", "ACGTA", "ACNNNN="]
    assert r.extract("d", 1, 4) == "CGT" and r.extract("d", 5, 3) == "" and r.extract("d", 100, 200) == ""
    assert plain_codec.pack4(C.as_bytes("ACG")).hex() == "1240" and plain_codec.pack2(C.as_bytes("TCAG")).hex() == "1b"


@pytest.mark.parametrize("writer", [TwoBitWriter("/x", [], False, False, "none"), FourBitWriter("/x", [])])
def test_long_names_are_errors(writer):
    with pytest.raises(ValueError, match="255"):
        image(writer, [("n" * 256, "A")])


def test_detection():
    assert detect(twobit([])) == "twobit" and detect(b">a\n") == "fasta" and detect(b"4BIT") == "fourbit"
    with pytest.raises(ValueError):
        detect(b"what")


def test_fai_text():
    assert parse_fai("a\t4\t3\t4\t5\textra\n\n") == [("a", 4, 3, 4, 5)]
    with pytest.raises(ValueError, match="line 2"):
        parse_fai("a\t4\t3\t4\t5\nb\t1\n")
    assert scan_fai(b">a d\nACGT\nAC\n>b\n>c\nTT\n") == [("a", 6, 5, 4, 5), ("b", 0, 16, 0, 0), ("c", 2, 19, 2, 3)]
    assert scan_fai(b"> chr1\r\nAC\r\nG\r\n") == [("chr1", 3, 8, 2, 4)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ACGTNRYSWKMBDHVacgtnryswkmbdhv-*UX=", max_size=80), st.integers(0, 90), st.integers(0, 90))
def test_any_bases(bases, a, b):
    seqs = [("s", bases)]
    r = TwoBitReader(MemorySource(twobit(seqs, iub=True)))
    assert r.extract("s", a, b) == degrade(bases, True)[a:b]
    assert TwoBeReader(MemorySource(image(TwoBeWriter("/x", []), seqs))).extract("s", a, b) == degrade(bases, True)[a:b]


ROWS = st.lists(st.tuples(st.text(alphabet="abZ é", max_size=9), st.text(alphabet="ACGTNNNRRYSacgtnnrry-*é漢", max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(ROWS, st.sampled_from([1, 7, 4 << 20]))
def test_batches_equal_single_records(seqs, together):
    """Whatever rows a batch has, empty ones among them, and however it is cut."""
    batch = pa.RecordBatch.from_arrays([pa.array([s[i] for s in seqs], pa.string()) for i in (0, 1)], names=["name", "bases"])
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(["x"], pa.string()), c])[1:] for c in batch.columns], names=["name", "bases"])
    old, B.TOGETHER = B.TOGETHER, together
    try:
        for writer, single in (
            (TwoBitWriter("/x", [], False, True, "none"), lambda n, b: plain_codec.twobit_record(b, True)), (TwoBitWriter("/x", [], False, False, "none"), lambda n, b: plain_codec.twobit_record(b, False)),
            (TwoBeWriter("/x", []), lambda n, b: plain_codec.twobe_record(b)), (FourBitWriter("/x", []), plain_codec.fourbit_record),
        ):
            parts = list(writer.encode(batch))
            assert b"".join(r.data.tobytes() for _, r in parts) == b"".join(single(n, b) for n, b in seqs)
            assert b"".join(n.data.tobytes() for n, _ in parts).decode() == "".join(n for n, _ in seqs)
            assert [x for _, r in parts for x in r.sizes.tolist()] == [len(single(n, b)) for n, b in seqs]
    finally:
        B.TOGETHER = old


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9c", max_size=6), max_size=700), st.randoms())
def test_trees_equal_plain_ones(names, rng):
    raw = [n.encode() for n in names]
    numbers = sorted(rng.sample(range(1 << 40), len(raw)))
    strings = B.Ragged(np.frombuffer(b"".join(raw), np.uint8), B.sums(np.array([len(r) for r in raw], np.int64)))
    assert C.build_tree(strings.padded(), np.array(numbers, np.int64)) == plain_codec.build_tree(list(zip(raw, numbers, strict=True)))


class Counted:
    """A source that keeps what was read of it."""

    requests = fetched = 0

    def __init__(self, data: bytes):
        self.under, self.size, self.reads = MemorySource(data), len(data), []

    def read_at(self, offset, n):
        self.reads.append((offset, n))
        return self.under.read_at(offset, n)


REPEATED = sorted([(f"seq{i:05d}", "ACGTNNac"[: 1 + i % 8]) for i in range(3000)] + [("seq00255", "AAAA"), ("seq00256", "CCCC"), ("seq00256", "GGGG"), ("seq01000", "TT")], key=lambda x: x[1])


@pytest.mark.parametrize("kind", ["ptr", "bpt", "twobe"])
def test_lookups_read_few_nodes(kind):
    """Names that repeat or stand at a node's border are all found; no table of contents is read."""
    data = image(TwoBeWriter("/x", []), REPEATED) if kind == "twobe" else twobit(REPEATED, iub=True, index=kind)
    source = Counted(data)
    reader = TwoBeReader(source) if kind == "twobe" else TwoBitReader(source)
    at = {}
    for i, (n, b) in enumerate(REPEATED):
        at.setdefault(n, []).append((i, b))
    for name in [*dict(REPEATED), "seq", "seq99999", "", "z" * 300]:
        source.reads.clear()
        hits = reader.find_all(name)
        # the tree's header, two levels of nodes, each a header and its entries, and one more at a border
        assert len(source.reads) <= (1 + 2 * (2 + 1) if kind != "ptr" else 2 * (12 + 1 + len(hits)))
        assert sum(n for _, n in source.reads) < 12_000
        if name in at:
            assert sorted(reader.extract_at(p) for p, _ in hits) == sorted(b for _, b in at[name])
            assert reader.find(name) in [p for p, _ in hits]
        else:
            assert hits == [] and reader.find(name) is None
    name = "seq00256"
    marks = [m for _, m in reader.find_all(name)]
    source.reads.clear()
    assert sorted(reader.ordinals_of(marks)) == [i for i, _ in at[name]]
    if kind == "ptr":
        assert source.reads == [(reader.index_at, 8 * len(REPEATED))]


@pytest.mark.parametrize("kind", ["ptr", "bpt", "twobe", "flat"])
def test_named_scans(kind, tmp_path, monkeypatch):
    """Planning a named scan of an indexed file reads its header only."""
    from pyspark.sql.datasource import EqualTo, In

    data = image(TwoBeWriter("/x", []), REPEATED) if kind == "twobe" else twobit(REPEATED, iub=True, index="none" if kind == "flat" else kind)
    path = tmp_path / "x"
    path.write_bytes(data)
    if kind != "flat":
        for c in (TwoBeReader, TwoBitReader):
            monkeypatch.setattr(c, "toc", lambda self: pytest.fail("the table of contents is read") if kind == "ptr" else self._toc)
    for columns in (["file", "ordinal", "name", "bases"], ["name", "bases"]):
        reader = ContainerReader("twobe" if kind == "twobe" else "twobit", str(path), 100, columns)
        assert list(reader.pushFilters([In(("name",), ("seq00256", "seq00007", "nope", None)), EqualTo(("bases",), "x")]))
        parts = reader.partitions()
        assert kind == "flat" or [p.names for p in parts] == [["nope", "seq00007", "seq00256"]]
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        want = [{"file": str(path), "ordinal": i, "name": n, "bases": b} for i, (n, b) in enumerate(REPEATED) if n in ("seq00256", "seq00007")]
        assert sorted(rows, key=str) == sorted(({c: r[c] for c in columns} for r in want), key=str)
