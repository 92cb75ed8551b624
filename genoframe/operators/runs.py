"""Runs of bases as intervals: N blocks, IUB blocks, the soft mask and the edit stream.

A sequence is cut into segments by one regular expression whose alternatives cover
every base. Only the segments' lengths and codes are moved: a window adds the lengths
up to starts. ``sequences`` are rows of ``ordinal``, ``name`` and ``bases``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.alphabet import IUB_CODES

N_RUN, IUB_POINT, IUB_RUN, MASK_RUN = 0, 1, 2, 3

_CODES = "|".join(f"[{c}{c.lower()}]+" for c in IUB_CODES)
_CODE_CLASS = IUB_CODES + IUB_CODES.lower()
N_BLOCKS = "[^ACGTacgt]+"
MASK_BLOCKS = "[a-z]+"
IUB_BLOCKS = _CODES
#: N and junk, which a stream with codes keeps apart from them.
N_ONLY = f"[^ACGTacgt{_CODE_CLASS}]+"


def runs(sequences: DataFrame, pattern: str, rest: str) -> DataFrame:
    """Matches of ``pattern`` as ``ordinal, name, start, size, code``; ``rest`` matches
    whatever stands between them. The code is the run's first base, in upper case."""
    parts = F.regexp_extract_all("bases", F.lit(f"((?:{pattern})|(?:{rest}))"), F.lit(1))
    cut = sequences.select("ordinal", "name", F.posexplode(parts).alias("k", "part"))
    cut = cut.select("ordinal", "name", "k", F.length("part").cast("long").alias("size"), F.substring("part", 1, 1).alias("base"))
    before = Window.partitionBy("ordinal", "name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    return cut.where(F.col("base").rlike(f"^(?:{pattern})$")).select("ordinal", "name", "start", "size", F.upper("base").alias("code"))


def _in_tiles(tiles: DataFrame, tile: int, kinds: tuple[str, ...], borders: bool) -> DataFrame:
    """The runs that touch a border of two tiles, or all others, placed in their sequences."""
    from genoframe.operators import tiles as T

    # a sequence of one tile has no borders
    lists = T.found(tiles.where(F.col("total") > tile) if borders else tiles, tile, kinds, borders)
    rows = lists.select("ordinal", "name", "tile", "kind", F.explode("runs").alias("run"))
    low = F.col("tile") * F.lit(tile).cast("long")
    return rows.select("ordinal", "name", "kind", (low + F.col("run.start")).alias("start"), F.col("run.size").cast("long").alias("size"), F.col("run.code").alias("code"))


def _joined(ends: DataFrame, *first: str) -> DataFrame:
    """Runs that touch borders, joined where tiles cut them; of each the ``first`` piece's
    other columns."""
    order = Window.partitionBy("ordinal", "name", "kind").orderBy("start")
    # a run goes on where the one before it ends here with the same code
    goes_on = (F.lag(F.col("start") + F.col("size")).over(order) == F.col("start")) & (F.lag("code").over(order) == F.col("code"))
    number = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = (F.min_by(c, "start").alias(c) for c in first)
    joined = ends.withColumn("run", number).groupBy("ordinal", "name", "kind", "code", "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"), *own)
    return joined.select("ordinal", "name", "kind", "start", "size", "code", *first)


def tile_runs(tiles: DataFrame, tile: int, kinds: tuple[str, ...]) -> DataFrame:
    """``ordinal, name, kind, start, size, code`` (a letter's number) of whole sequences' runs,
    from rows of ``name, ordinal, tile, total, bases`` with up to ``tile`` bases: no task needs
    more than a tile's bases. Only runs that touch a border of two tiles are compared with
    their neighbours, the others are rows where they were found."""
    return _in_tiles(tiles, tile, kinds, False).unionByName(_joined(_in_tiles(tiles, tile, kinds, True)))


def _lettered(runs: DataFrame) -> DataFrame:
    return runs.withColumn("code", F.when(F.col("kind") == "IUB", F.char("code")))


def tile_blocks(tiles: DataFrame, tile: int) -> DataFrame:
    """All three kinds of blocks, with their ``kind``, as ``blocks`` gives them."""
    return _lettered(tile_runs(tiles, tile, ("N", "MASK", "IUB"))).select("ordinal", "name", "start", "size", "code", "kind")


def tile_block_lists(tiles: DataFrame, tile: int) -> list[DataFrame]:
    """The same blocks as lists by tile, which ``overlay_lists`` takes: those within tiles,
    and those that touch their borders."""
    from genoframe.operators import tiles as T

    ends = _joined(_in_tiles(tiles, tile, ("N", "MASK", "IUB"), True))
    return [T.lists(tiles, tile).withColumn("tile", F.col("tile").cast("long")), block_lists(_lettered(ends), tile)]


def tile_stats(tiles: DataFrame) -> DataFrame:
    """Length and numbers of N, mask and IUB blocks of every sequence, from its tiles: blocks
    are counted in each, less those that go on from the tile before. Only the tiles' counts
    and their first and last bases are shuffled."""
    rows = tiles.select(
        "ordinal", "name", "tile", "total", F.substring("bases", 1, 1).alias("first"), F.substring("bases", -1, 1).alias("last"),
        _count(N_BLOCKS).alias("n_blocks"), _count(MASK_BLOCKS).alias("mask_blocks"), _count(IUB_BLOCKS).alias("iub_blocks"),
    )
    before = F.lag("last").over(Window.partitionBy("ordinal", "name").orderBy("tile"))
    rows = rows.withColumn("before", F.coalesce(before, F.lit("")))
    both = lambda pattern: F.col("before").rlike(f"^{pattern}$") & F.col("first").rlike(f"^{pattern}$")
    goes_on = {"n_blocks": both("[^ACGTacgt]"), "mask_blocks": both("[a-z]"), "iub_blocks": both(f"[{_CODE_CLASS}]") & (F.upper("before") == F.upper("first"))}
    return rows.groupBy("ordinal", "name").agg(F.max("total").alias("len"), *(F.sum(F.col(c) - F.when(joined, 1).otherwise(0)).alias(c) for c, joined in goes_on.items()))


def tile_edits(tiles: DataFrame, tile: int) -> DataFrame:
    """As ``edits``, from tiles. What a base adds to its layer is joined across tiles first, so
    points that meet at a tile's end are a run; base and mask layers are joined apart."""
    return _as_edits(tile_runs(tiles, tile, ("BASE", "MASK")))


def _as_edits(runs: DataFrame, *more: str) -> DataFrame:
    masked, is_n = F.col("kind") == "MASK", F.col("code") == ord("N")
    etype = F.when(masked, MASK_RUN).when(is_n, N_RUN).when(F.col("size") == 1, IUB_POINT).otherwise(IUB_RUN)
    return runs.select("ordinal", "name", F.col("start").alias("pos"), F.col("size").alias("len"), etype.cast("int").alias("etype"), F.when(masked | is_n, "").otherwise(F.char("code")).alias("code"), *more)


def tile_index(tiles: DataFrame, tile: int) -> DataFrame:
    """The run index of sequences from their tiles. Edits are numbered within their tile, and
    only numbers of edits by tile are summed over a sequence: those that go on from the tile
    before aren't counted again. Points stay where they are found."""
    from genoframe.operators import tiles as T

    kinds = ("BASE", "MASK")
    rows = tiles.select("ordinal", "name", "tile", F.substring("bases", 1, 1).alias("first"), F.substring("bases", -1, 1).alias("last"), (_count(N_ONLY) + _count(IUB_BLOCKS) + _count(MASK_BLOCKS)).alias("count"))
    order = Window.partitionBy("ordinal", "name").orderBy("tile")
    rows = rows.withColumn("before", F.coalesce(F.lag("last").over(order), F.lit("")))
    both = lambda pattern: F.col("before").rlike(f"^{pattern}$") & F.col("first").rlike(f"^{pattern}$")
    base = both(f"[^ACGTacgt{_CODE_CLASS}]") | (both(f"[{_CODE_CLASS}]") & (F.upper("before") == F.upper("first")))
    rows = rows.withColumn("again", base.cast("long") + both("[a-z]").cast("long"))
    past = F.coalesce(F.sum(F.col("count") - F.col("again")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = rows.select("ordinal", "name", "tile", past.alias("base"), "again")

    def rows_of(lists: DataFrame, *more: str) -> DataFrame:
        run = lists.select("ordinal", "name", "tile", "kind", *more, F.explode("runs").alias("run"))
        low = F.col("tile") * F.lit(tile).cast("long")
        return run.select("ordinal", "name", "tile", "kind", *more, (low + F.col("run.start")).alias("start"), F.col("run.size").cast("long").alias("size"), F.col("run.code").alias("code"), F.col("run.local").alias("local"))

    inner = rows_of(T.found(tiles, tile, kinds, False, True).join(number, ["ordinal", "name", "tile"]), "base", "again")
    ends = rows_of(T.found(tiles.where(F.col("total") > tile), tile, kinds, True, True))
    every = _as_edits(inner, "base", "again", "local").unionByName(_as_edits(_joined(ends, "tile", "local").join(number, ["ordinal", "name", "tile"]), "base", "again", "local"))
    # a tile's first edit stands before any that go on, unless it does so itself
    local = F.when(F.col("local") == 0, F.lit(0).cast("long")).otherwise(F.col("local") - F.col("again"))
    return every.where(F.col("etype") != IUB_POINT).withColumn("place", F.col("base") + local).drop("base", "again", "local")


def tile_run_index(stream: DataFrame, tile: int) -> DataFrame:
    """As ``run_index``, by tiles: edits are numbered within the tile that they begin in, and
    only numbers of edits by tile are summed over a whole sequence."""
    placed = stream.withColumn("tile", F.floor(F.col("pos") / tile))
    counts = placed.groupBy("ordinal", "name", "tile").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("ordinal", "name").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ordinal", "name", "tile", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("ordinal", "name", "tile").orderBy("pos", "etype")
    numbered = placed.withColumn("local", F.row_number().over(local) - 1).where(F.col("etype") != IUB_POINT)
    return numbered.join(counts, ["ordinal", "name", "tile"]).withColumn("place", (F.col("base") + F.col("local")).cast("long")).drop("tile", "base", "local")


def n_blocks(sequences: DataFrame) -> DataFrame:
    """Runs of whatever is not ACGT: N, codes and junk together."""
    return runs(sequences, N_BLOCKS, "[ACGTacgt]+").drop("code")


def mask_blocks(sequences: DataFrame) -> DataFrame:
    return runs(sequences, MASK_BLOCKS, "[^a-z]+").drop("code")


def iub_blocks(sequences: DataFrame) -> DataFrame:
    """Runs of one degenerate code, in either case."""
    return runs(sequences, IUB_BLOCKS, f"[^{_CODE_CLASS}]+")


def blocks(sequences: DataFrame) -> DataFrame:
    """All three kinds of blocks, with their ``kind``."""
    none = F.lit(None).cast("string")
    parts = ((n_blocks(sequences).withColumn("code", none), "N"), (mask_blocks(sequences).withColumn("code", none), "MASK"), (iub_blocks(sequences), "IUB"))
    n, mask, iub = (df.withColumn("kind", F.lit(kind)) for df, kind in parts)
    return n.unionByName(mask).unionByName(iub)


def edits(sequences: DataFrame) -> DataFrame:
    """The edit stream: ``ordinal, name, pos, len, etype, code``. Order it by ``pos`` and
    ``etype`` within a sequence."""
    base = runs(sequences, f"{_CODES}|{N_ONLY}", "[ACGTacgt]+")
    code = F.col("code").rlike(f"^[{IUB_CODES}]$")
    kind = F.when(~code, N_RUN).when(F.col("size") == 1, IUB_POINT).otherwise(IUB_RUN)
    base = base.select("ordinal", "name", F.col("start").alias("pos"), F.col("size").alias("len"), kind.cast("int").alias("etype"), F.when(code, F.col("code")).otherwise("").alias("code"))
    mask = mask_blocks(sequences).select("ordinal", "name", F.col("start").alias("pos"), F.col("size").alias("len"), F.lit(MASK_RUN).alias("etype"), F.lit("").alias("code"))
    return base.unionByName(mask)


def run_index(stream: DataFrame) -> DataFrame:
    """The places, in a sequence's ordered stream, of the edits that are not points."""
    order = Window.partitionBy("ordinal", "name").orderBy("pos", "etype")
    placed = stream.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    return placed.where(F.col("etype") != IUB_POINT)


# -- counts, without positions: nothing is exploded or shuffled ------------------
def _count(pattern: str) -> Column:
    return F.regexp_count("bases", F.lit(pattern)).cast("long")


def twobit_stats(sequences: DataFrame) -> DataFrame:
    """Length and numbers of N, mask and IUB blocks of every sequence."""
    return sequences.select(
        "ordinal", "name", F.length("bases").cast("long").alias("len"),
        _count(N_BLOCKS).alias("n_blocks"), _count(MASK_BLOCKS).alias("mask_blocks"), _count(IUB_BLOCKS).alias("iub_blocks"),
    )


def twobe_stats(sequences: DataFrame) -> DataFrame:
    """Length and number of edits of every sequence."""
    edits = _count(N_ONLY) + _count(IUB_BLOCKS) + _count(MASK_BLOCKS)
    return sequences.select("ordinal", "name", F.length("bases").cast("long").alias("len"), edits.alias("edits"))


def sequence_infos(sequences: DataFrame) -> DataFrame:
    return sequences.select("ordinal", "name", F.length("bases").cast("long").alias("len"))


# -- overlap and overlay ---------------------------------------------------------
BIN = 1 << 17


def overlapping(regions: DataFrame, blocks: DataFrame, size: int = BIN) -> DataFrame:
    """Parts of blocks within regions. ``regions`` have ``name, start, end``; ``clip_start``
    is relative to the region's start, as is usual for a decoded window.

    An equi-join on the name and the bins of ``size`` bases that both touch, so that a long
    sequence's blocks and regions meet only near each other; a pair counts in the first
    bin that it shares."""
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size)))
    b = blocks.select(F.col("name").alias("of"), F.col("start").alias("b_start"), F.col("size").alias("b_size"), *[c for c in blocks.columns if c in ("kind", "code")])
    b = b.where("b_size > 0").withColumn("b_bin", bins(F.col("b_start"), F.col("b_start") + F.col("b_size")))
    r = regions.where(F.col("end") > F.col("start")).withColumn("_bin", bins(F.col("start"), F.col("end")))
    met = r.join(b, (F.col("name") == F.col("of")) & (F.col("_bin") == F.col("b_bin")) & (F.col("b_start") < F.col("end")) & (F.col("b_start") + F.col("b_size") > F.col("start")))
    met = met.where(F.col("_bin") == F.floor(F.greatest("b_start", "start") / size))
    s, e = F.greatest("b_start", "start"), F.least(F.col("b_start") + F.col("b_size"), F.col("end"))
    return met.drop("of", "_bin", "b_bin").withColumns({"clip_start": s - F.col("start"), "clip_size": e - s})


def block_lists(blocks: DataFrame, tile: int) -> DataFrame:
    """``name, tile`` and lists, by kind, of the starts, sizes and codes of blocks' parts in it."""
    from genoframe.operators import tiles as T

    span = blocks.where("size > 0").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.col("size") - 1) / tile))))
    low = F.col("tile") * tile
    a, b = F.greatest(F.col("start"), low) - low, F.least(F.col("start") + F.col("size"), low + tile) - low
    values = {"start": a.cast("int"), "size": (b - a).cast("int"), "code": F.ascii(F.upper("code")).cast("tinyint")}
    return span.groupBy("name", "tile").agg(*(F.collect_list(F.when(F.col("kind") == kind, values[c.rpartition("_")[2]])).alias(c) for c, kind in T.LISTED.items()))


def overlay(tiles: DataFrame, blocks: DataFrame, tile: int) -> DataFrame:
    """Decoded tiles with blocks laid over them, N first, then codes, then the mask: what
    ``blocks`` were taken from. ``blocks`` have ``name, kind, start, size, code`` and those of
    a kind don't overlap."""
    return overlay_lists(tiles, block_lists(blocks, tile))


def overlay_lists(tiles: DataFrame, *lists: DataFrame) -> DataFrame:
    """The same with blocks as lists by tile: a tile meets its lists, a few bytes a block, and
    a task lays them over its bases."""
    from genoframe.operators import tiles as T

    met = tiles.select("name", "ordinal", F.col("tile").cast("long").alias("tile"), "total", "bases")
    have: dict[str, list[Column]] = {c: [] for c in T.LISTED}
    for k, more in enumerate(lists):
        keys = [c for c in ("ordinal", "name", "tile") if c in more.columns]
        met = met.join(more.select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in T.LISTED)), keys, "left")
        for c in T.LISTED:
            have[c].append(F.coalesce(F.col(f"{c}_{k}"), F.array().cast(more.schema[c].dataType)))
    return T.laid(met.select("name", "ordinal", "tile", "total", "bases", *(F.concat(*v).alias(c) for c, v in have.items())))
