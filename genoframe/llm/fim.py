"""Fill-in-the-middle: a text is cut in three at token borders and put in another order.

Tokens are a run of other characters with the ASCII spaces before it, and spaces at the end
of the text. They are found without a loop over characters: ``bytes.translate`` turns a
text's bytes into digits of its class, which are one large integer of a bit for each byte;
shifted by a place and combined with itself it has a bit where a token ends. ``bit_count``
gives the number of tokens, and halving the integer again and again, by the count of its
lower half, the place of the bit that has a given rank. Characters are counted the same way,
by a mask of the bytes that begin one.

Cuts and forms follow from SHA-256 of the seed and the key alone, so they don't depend on how
rows are dealt. One pass over the rows without a shuffle; a text is used whole.

Defined results: a null text counts as empty; a text that is empty or holds a mark stays
plain; a null key counts as an empty one; repeated rows give repeated results; bytes that are
no valid UTF-8 go through as they are, each that begins no character counting with the one
before it; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Of a hundred texts so many are taken apart, and of a hundred of these so many put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Rows that are made together.
TOGETHER = 500

#: For each byte the digit of its class.
NO_SPACE = bytes(48 + (b not in b" \t\n\v\f\r") for b in range(256))
BEGINS = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))


def mask(raw: bytes, classes: bytes) -> int:
    """A bit for each byte, the first lowest, that says whether it is of the class."""
    return int(raw.translate(classes)[::-1], 2) if raw else 0


def token_ends(raw: bytes) -> int:
    """A bit at the last byte of each token."""
    if not raw:
        return 0
    words = mask(raw, NO_SPACE)
    ends = words ^ (words & words >> 1)
    return ends | 1 << len(raw) - 1  # the text's end: of its last word, or of the spaces behind it


def place_of(bits: int, rank: int, width: int) -> int:
    """The place of the bit that has ``rank - 1`` bits below it, among ``width`` places."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank <= below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def choices(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits for a key."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(raw: bytes, numbers: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, characters of prefix and middle, and the text in its form."""
    ends = token_ends(raw)
    n = ends.bit_count()
    if not raw or numbers[2] % 100 >= rate or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    low, high = (place_of(ends, k, len(raw)) + 1 if k else 0 for k in sorted((numbers[0] % (n + 1), numbers[1] % (n + 1))))
    begins = (1 << len(raw)) - 1 if raw.isascii() else mask(raw, BEGINS)
    before, upto = ((begins & (1 << at) - 1).bit_count() for at in (low, high))
    prefix, middle, suffix = raw[:low], raw[low:high], raw[high:]
    if numbers[3] % 100 < suffix_first:
        return n, "spm", before, upto - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, upto - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``key``, ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` of every row."""
    names = ["k", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                made = [transform(raw or b"", choices(seed, k or ""), rate, suffix_first) for k, raw in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    k = F.col(key)
    rows = docs.select(k.alias("k"), k.cast("string").alias("decimal"), F.col(text).cast("string").cast("binary").alias("raw"))
    made = rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string")).withColumnRenamed("k", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. A text that was taken apart holds no
    mark, and no mark can arise where parts meet, so each mark's first place is its own."""
    size = len(PREFIX)
    p, s, m = (F.instr(output, F.lit(mark.decode())) for mark in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(output, m + size, F.length(output))
    psm = F.concat(F.substring(output, p + size, s - p - size), middle, F.substring(output, s + size, m - s - size))
    spm = F.concat(F.substring(output, p + size, m - p - size), middle, F.substring(output, s + size, p - s - size))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
