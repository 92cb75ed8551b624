"""Base alphabets and column expressions on strings of bases.

All are built-in expressions, so they stay in generated code and are pushed down and
pruned like any other. Bases keep their case, which is the soft mask.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
IUB_CODES = "RYSWKMBDHV"
TWOBIT_ORDER = "TCAG"
NIBBLE_ORDER = "=ACMGRSVTWYHKDBN"

ACGT = "ACGTacgt"
_IUB_BOTH = IUB_CODES + IUB_CODES.lower()


def is_acgt(base: Column) -> Column:
    """Whether a base is A, C, G or T in either case."""
    return base.rlike("^[ACGTacgt]$")


def is_iub_degenerate(base: Column) -> Column:
    """Whether a base is one of the ten degenerate codes, N not among them."""
    return base.rlike(f"^[{_IUB_BOTH}]$")


def base_class(base: Column) -> Column:
    """``plain``, ``iub`` or ``n``; whatever is neither plain nor a code counts as N."""
    return F.when(is_acgt(base), "plain").when(is_iub_degenerate(base), "iub").otherwise("n")


def base_count(bases: Column) -> Column:
    return F.length(bases).cast("long")


def fold_upper(bases: Column) -> Column:
    """What a container without a mask keeps."""
    return F.upper(bases)


def degrade(bases: Column) -> Column:
    """What a standard 2-bit record keeps: codes and junk become N, in their case."""
    return F.regexp_replace(F.regexp_replace(bases, "[^ACGTa-z]", "N"), "[a-z&&[^acgt]]", "n")


def degrade_iub(bases: Column) -> Column:
    """What a 2-bit record with the IUB table keeps: junk becomes N, in its case."""
    low = "acgtn" + IUB_CODES.lower()
    return F.regexp_replace(F.regexp_replace(bases, f"[^ACGTN{IUB_CODES}a-z]", "N"), f"[a-z&&[^{low}]]", "n")


def nibble_fold(bases: Column) -> Column:
    """What a 4-bit record keeps: upper case, unknown bases as N."""
    return F.regexp_replace(F.upper(bases), f"[^{NIBBLE_ORDER}]", "N")


def pack2(bases: Column) -> Column:
    """Two bits a base, the first in the high bits; what is not ACGT packs as T."""
    digits = F.translate(F.regexp_replace(F.upper(bases), "[^ACGT]", "T"), TWOBIT_ORDER, "0123")
    digits = F.rpad(digits, ((F.length(bases) + 3) / 4).cast("int") * 4, "0")
    # 32 digits of base 4 are 16 of base 16, as many as conv takes; the last part is shorter
    words = F.transform(F.regexp_extract_all(digits, F.lit("(.{1,32})"), F.lit(1)), lambda w: F.lpad(F.conv(w, 4, 16), (F.length(w) / 2).cast("int"), "0"))
    return F.when(bases == "", F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(words, "")))


def unpack2(packed: Column, size: Column) -> Column:
    """The first ``size`` bases of a packed column, upper case."""
    words = F.regexp_extract_all(F.hex(packed), F.lit("(.{1,16})"), F.lit(1))
    digits = F.array_join(F.transform(words, lambda w: F.lpad(F.conv(w, 16, 4), F.length(w) * 2, "0")), "")
    return F.substring(F.translate(digits, "0123", TWOBIT_ORDER), F.lit(1), size.cast("int"))


def pack4(bases: Column) -> Column:
    """Four bits a base, the first in the high nibble."""
    digits = F.translate(nibble_fold(bases), NIBBLE_ORDER, "0123456789ABCDEF")
    return F.unhex(F.rpad(digits, ((F.length(bases) + 1) / 2).cast("int") * 2, "0"))


def unpack4(packed: Column, size: Column) -> Column:
    return F.translate(F.substring(F.hex(packed), F.lit(1), size.cast("int")), "0123456789ABCDEF", NIBBLE_ORDER)


def packed2_bytes(size: Column) -> Column:
    return ((size + 3) / 4).cast("long")


def packed4_bytes(size: Column) -> Column:
    return ((size + 1) / 2).cast("long")


def clamp(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """A 0-based half-open window brought within a sequence; a null end is the sequence's."""
    end = F.least(F.coalesce(end, size), size)
    return F.least(start, end), end


def region_name(name: Column, start: Column, end: Column) -> Column:
    """A region as it was asked for; the name alone without an end."""
    return F.when(end.isNull(), name).otherwise(F.concat(name, F.lit(":"), start, F.lit("-"), end))


def fai_position(base: Column, offset: Column, linebases: Column, linewidth: Column) -> Column:
    """The byte of a base in an indexed FASTA file."""
    per_line = F.greatest(linebases, F.lit(1).cast("long"))
    return offset + (base / per_line).cast("long") * linewidth + base % per_line


def strip_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n]", "")


def wrap(bases: Column, width: int) -> Column:
    """Lines of ``width`` bases; one line if it is 0."""
    return F.regexp_replace(bases, f"(.{{{width}}})(?=.)", "$1\n") if width else bases
