"""Runs within tiles, and tiles that runs are laid over, an Arrow batch at a time.

A tile's runs are one list of small numbers, so that nothing but what touches a border of two
tiles needs a window, and what is shuffled is a few bytes a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, ByteType, IntegerType, StringType, StructField, StructType

from genoframe.sources import batch as B
from genoframe.sources import codec as C

KEYS = ["ordinal", "name", "tile", "total"]
#: What a base is in each layer; 0 for what belongs to no run.
VALUES = {"N": B.NOT_PLAIN, "MASK": B.LOWER, "IUB": C.CODE, "BASE": B.EDITED}
#: The order in which layers are laid over decoded bases: a later one changes what is there.
LAYERS = ("N", "IUB", "MASK")
#: Bases whose runs are found together.
TOGETHER = 1 << 20
FIELDS = {"start": (IntegerType(), pa.int32()), "size": (IntegerType(), pa.int32()), "code": (ByteType(), pa.int8()), "local": (IntegerType(), pa.int32())}
#: Lists of a tile's runs by layer, for those that are laid over it.
LISTED = {f"{layer}_{c}": layer for layer in LAYERS for c in ("start", "size", *(["code"] if layer == "IUB" else []))}
SMALL = np.arange(256, dtype=np.uint32)
SMALL[ord("A") : ord("Z") + 1] += 32


def found(tiles: DataFrame, tile: int, kinds: tuple[str, ...], borders: bool, numbered: bool = False) -> DataFrame:
    """``ordinal, name, tile, total, kind, runs`` with a row for each tile and kind that has
    some: the runs that touch a border to another tile, or all others; ``start`` counts within
    the tile. ``numbered`` runs have their number, ``local``, among all of the tile's in the
    order of start and kind; runs of one code of one base that touch no border are left out then."""
    names = [c for c in FIELDS if numbered or c != "local"]
    run = StructType([StructField(c, FIELDS[c][0]) for c in names])
    schema = StructType([*(tiles.schema[c] for c in KEYS), StructField("kind", StringType()), StructField("runs", ArrayType(run))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, keys = B.one_byte_a_base(batch.column("bases")), batch.select(KEYS)
            for low, high in B.pieces(bases, TOGETHER):
                part, own = bases.part(low, high), keys.slice(low, high - low)
                at = own.column("tile").to_numpy().astype(np.int64) * tile
                last = at + part.sizes >= own.column("total").to_numpy()
                runs = [B.runs_by_row(VALUES[kind][part.data], part) for kind in kinds]
                local = _numbers(runs) if numbered else [None] * len(runs)
                for kind, r, number in zip(kinds, runs, local, strict=True):
                    keep = _touches(r, part, at, last)
                    keep = keep if borders else ~keep
                    if numbered and not borders and kind == "BASE":
                        keep &= (r.size > 1) | (r.value == ord("N"))
                    columns = {"start": r.start, "size": r.size, "code": r.value, "local": number}
                    yield _lists(own, kind, r.row[keep], {c: columns[c][keep] for c in names}, schema)

    return tiles.select(*KEYS, "bases").mapInArrow(look, schema)


def lists(tiles: DataFrame, tile: int) -> DataFrame:
    """``ordinal, name, tile`` and LISTED: of each tile all blocks that touch no border."""
    of = lambda c: FIELDS[c.rpartition("_")[2]]
    schema = StructType([*(tiles.schema[c] for c in KEYS[:3]), *(StructField(c, ArrayType(of(c)[0])) for c in LISTED)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = B.one_byte_a_base(batch.column("bases"))
            for low, high in B.pieces(bases, TOGETHER):
                part, own = bases.part(low, high), batch.slice(low, high - low)
                at = own.column("tile").to_numpy().astype(np.int64) * tile
                last = at + part.sizes >= own.column("total").to_numpy()
                columns = {}
                for layer in LAYERS:
                    r = B.runs_by_row(VALUES[layer][part.data], part)
                    keep = ~_touches(r, part, at, last)
                    ends = pa.array(B.sums(np.bincount(r.row[keep], minlength=high - low)).astype(np.int32))
                    for c, v in (("start", r.start), ("size", r.size), ("code", r.value)):
                        columns[f"{layer}_{c}"] = ends, v[keep]
                made = [pa.ListArray.from_arrays(columns[c][0], pa.array(columns[c][1].astype(of(c)[1].to_pandas_dtype()))) for c in LISTED]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in KEYS[:3]), *made], names=schema.names)

    return tiles.select(*KEYS, "bases").mapInArrow(look, schema)


def _touches(r: B.Runs, bases: B.Ragged, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which runs touch a border to another tile."""
    return ((r.start == 0) & (at[r.row] > 0)) | ((r.start + r.size == bases.sizes[r.row]) & ~last[r.row])


def _numbers(runs: list[B.Runs]) -> list[np.ndarray]:
    """The number of each run among all of its row's, by start and then by its layer."""
    row, start = (np.concatenate([getattr(r, c) for r in runs]) for c in ("row", "start"))
    layer = np.repeat(np.arange(len(runs)), [len(r.row) for r in runs])
    order = np.lexsort((layer, start, row))
    number = np.empty(len(row), np.int64)
    number[order] = np.arange(len(row)) - B.sums(sum(r.count for r in runs))[row[order]]
    return np.split(number, np.cumsum([len(r.row) for r in runs])[:-1])


def _lists(keys: pa.RecordBatch, kind: str, row: np.ndarray, columns: dict[str, np.ndarray], schema: StructType) -> pa.RecordBatch:
    """Runs as a list for each row that has some."""
    own, first = np.unique(row, return_index=True)
    ends = pa.array(np.append(first, len(row)).astype(np.int32))
    runs = pa.StructArray.from_arrays([pa.array(v.astype(FIELDS[c][1].to_pandas_dtype())) for c, v in columns.items()], names=list(columns))
    kept = keys.take(pa.array(own))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array([kind] * len(own), pa.string()), pa.ListArray.from_arrays(ends, runs)], names=schema.names)


def laid(tiles: DataFrame) -> DataFrame:
    """Tiles, of columns ``bases`` and LISTED among others, with the runs laid over the bases;
    the lists are gone."""
    kept = [f for f in tiles.schema.fields if f.name not in LISTED]
    schema = StructType([f if f.name != "bases" else StructField("bases", StringType()) for f in kept])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = "".join(strings := batch.column("bases").to_pylist())
            plain = whole.isascii()
            window = np.frombuffer(whole.encode("ascii" if plain else "utf-32-le"), np.uint8 if plain else np.uint32).copy()
            at = B.sums(np.array([len(s) for s in strings], np.int64))
            for layer in LAYERS:
                row = batch.column(f"{layer}_start").value_parent_indices().to_numpy()
                start, size, *code = (batch.column(c).flatten().to_numpy().astype(np.int64) for c, of in LISTED.items() if of == layer)
                if layer == "MASK":
                    C.lay(window, 0, at[row] + start, size, None, SMALL)
                else:
                    C.lay(window, 0, at[row] + start, size, ord("N") if layer == "N" else code[0])
            if plain:
                bases = pa.Array.from_buffers(pa.large_string(), len(strings), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(window.tobytes())]).cast(pa.string())
            else:
                text = window.tobytes().decode("utf-32-le")
                bases = pa.array([text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([bases if c == "bases" else batch.column(c) for c in schema.names], names=schema.names)

    return tiles.mapInArrow(lay, schema)
