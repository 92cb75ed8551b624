"""Tables of FASTA files: wrapped records, ``.fai`` rows and record sizes of containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.alphabet import packed2_bytes, packed4_bytes, wrap
from genoframe.operators.regions import prefix_sums


def fasta_record_bytes(name: Column, size: Column, width: int) -> Column:
    """Bytes of a written FASTA record; an empty sequence has one blank line."""
    lines = F.greatest(F.ceil(size / width), F.lit(1)) if width else F.lit(1)
    return (F.octet_length(name) + 2 + size + lines).cast("long")


def fasta_text(width: int) -> Column:
    """A record as text, without the last line's end."""
    return F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrap(F.col("bases"), width))


def fai_table(sequences: DataFrame, width: int = 60) -> DataFrame:
    """The index of the file that ``sequences`` would be written to."""
    size = F.length("bases").cast("long")
    rows = sequences.select("ordinal", "name", size.alias("length"), fasta_record_bytes(F.col("name"), size, width).alias("bytes"))
    rows = prefix_sums(rows, "bytes", out="begin")
    linebases = F.least(F.lit(width).cast("long"), F.col("length")) if width else F.col("length")
    offset = F.col("begin") + F.octet_length("name") + 2
    return rows.select("ordinal", "name", "length", offset.cast("long").alias("offset"), linebases.alias("linebases"), (linebases + 1).alias("linewidth"))


def fai_lines(fai: DataFrame) -> DataFrame:
    """The index as lines of tab-separated text."""
    return fai.select("ordinal", F.concat_ws("\t", "name", *(F.col(c).cast("string") for c in ("length", "offset", "linebases", "linewidth"))).alias("value"))


def twobit_record_bytes(size: Column, n: Column, mask: Column, iub: Column | None = None) -> Column:
    out = 16 + 8 * n + 8 * mask + packed2_bytes(size)
    return (out if iub is None else out + 4 + 9 * iub).cast("long")


def fourbit_record_bytes(name: Column, size: Column) -> Column:
    return (1 + F.octet_length(name) + 8 + packed4_bytes(size)).cast("long")


def twobe_record_bytes(size: Column, edits: Column, runs: Column) -> Column:
    return (12 + 10 * edits + 4 * runs + packed2_bytes(size)).cast("long")
