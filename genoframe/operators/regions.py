"""Regions, names and sequences looked up by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.alphabet import clamp, region_name


def parse_regions(specs: DataFrame, spec: str = "spec", ordinal: str = "ordinal") -> DataFrame:
    """``ordinal, name, start, end`` of ``name`` or ``name:start-end`` specs; blank ones
    are skipped. The last colon ends the name and the first dash the start. A bad range
    is an error when its row is read."""
    text = F.regexp_replace(F.col(spec), r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")
    rows = specs.select(F.col(ordinal).alias("ordinal"), text.alias("spec")).where("spec <> ''")
    name, span = F.regexp_extract("spec", "(?s)^(.*):([^:]*)$", 1), F.regexp_extract("spec", "(?s)^(.*):([^:]*)$", 2)
    ranged = F.instr("spec", ":") > 0
    bound = F.regexp_extract(span, r"^\+?([0-9]+)-\+?([0-9]+)$", 1), F.regexp_extract(span, r"^\+?([0-9]+)-\+?([0-9]+)$", 2)
    bad = F.raise_error(F.concat(F.lit("bad region: "), "spec"))
    start = F.when(~ranged, F.lit(0).cast("long")).when(bound[0] == "", bad.cast("long")).otherwise(F.try_to_number(bound[0], F.lit("9" * 19)).cast("long"))
    end = F.when(~ranged, F.lit(None).cast("long")).when(bound[1] == "", bad.cast("long")).otherwise(F.try_to_number(bound[1], F.lit("9" * 19)).cast("long"))
    return rows.select("ordinal", F.when(ranged, name).otherwise(F.col("spec")).alias("name"), start.alias("start"), end.alias("end"))


def last_by_name(sequences: DataFrame) -> DataFrame:
    """One sequence for each name: the last in file order."""
    newest = sequences.groupBy("name").agg(F.max("ordinal").alias("ordinal"))
    return sequences.join(newest, ["name", "ordinal"], "left_semi")


def extract(sequences: DataFrame, regions: DataFrame, unique: bool = False) -> DataFrame:
    """The bases of every region, requests kept with repeats: ``ordinal, name, start,
    end, region, bases``. An unknown name is an error. ``unique`` says that names are
    known not to repeat, which saves the search for the last of each."""
    found = sequences if unique else last_by_name(sequences)
    # where a base is a byte, a window of the bytes needs no walk from the first base
    plain = F.octet_length("bases") == F.length("bases")
    found = found.select(F.col("name").alias("of"), F.col("bases").cast("binary").alias("raw"), F.length("bases").cast("long").alias("size"), plain.alias("plain"))
    joined = regions.join(found, regions["name"] == found["of"], "left")
    missing = F.raise_error(F.concat(F.lit('no sequence named "'), regions["name"], F.lit('"'))).cast("long")
    s, e = clamp(F.col("start"), F.col("end"), F.coalesce("size", missing))
    at, size = (s + 1).cast("int"), (e - s).cast("int")
    bases = F.when(F.col("plain"), F.substring("raw", at, size).cast("string")).otherwise(F.substring(F.col("raw").cast("string"), at, size))
    return joined.select(regions["ordinal"], regions["name"], "start", "end", region_name(regions["name"], F.col("start"), F.col("end")).alias("region"), bases.alias("bases"))


# -- tiles: long sequences in rows of bounded size -------------------------------
TILE = 1 << 20


def to_tiles(sequences: DataFrame, tile: int = TILE) -> DataFrame:
    """``name, ordinal, tile, total, bases`` with at most ``tile`` bases a row, for long
    sequences: a region then reads only the tiles that it touches."""
    n = F.length("bases")
    number = F.explode(F.sequence(F.lit(0), F.greatest((n - 1) / tile, F.lit(0)).cast("int")))
    cut = sequences.select("name", "ordinal", n.cast("long").alias("total"), "bases", number.alias("tile"))
    return cut.withColumn("bases", F.substring("bases", F.col("tile") * tile + 1, F.lit(tile)))


def extract_from_tiles(tiles: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """As ``extract``, from tiles of uniquely named sequences. Names are looked up in the
    table of contents, then tiles by name and number. Equal requests are looked up once,
    so that a request itself is the key that its pieces are brought together by."""
    asked = regions.groupBy("ordinal", "name", "start", "end").agg(F.count(F.lit(1)).cast("int").alias("times"))
    toc = tiles.where("tile = 0").select(F.col("name").alias("of"), "total")
    rows = asked.join(toc, F.col("name") == F.col("of"), "left")
    missing = F.raise_error(F.concat(F.lit('no sequence named "'), "name", F.lit('"'))).cast("long")
    s, e = clamp(F.col("start"), F.col("end"), F.coalesce("total", missing))
    rows = rows.withColumns({"s": s, "e": e}).drop("of", "total")
    touched = F.when(F.col("e") > F.col("s"), F.sequence((F.col("s") / tile).cast("int"), ((F.col("e") - 1) / tile).cast("int")))
    wanted = rows.withColumn("tile", F.explode_outer(touched))
    t = tiles.select(F.col("name").alias("of"), F.col("tile").alias("number"), "bases")
    first = F.col("tile") * F.lit(tile).cast("long")
    low = F.greatest(F.col("s"), first) - first
    piece = F.substring("bases", (low + 1).cast("int"), (F.least(F.col("e"), first + tile) - first - low).cast("int"))
    pieces = wanted.join(t, (F.col("name") == F.col("of")) & (F.col("tile") == F.col("number")), "left").withColumn("piece", piece)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "piece"))), lambda x: x["piece"]), "")
    whole = pieces.groupBy("ordinal", "name", "start", "end", "times").agg(joined.alias("bases"))
    whole = whole.withColumn("repeat", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return whole.select("ordinal", "name", "start", "end", region_name(F.col("name"), F.col("start"), F.col("end")).alias("region"), "bases")


# -- sums over all rows before ---------------------------------------------------
#: Rows of a range that one window adds up.
RANGE = 1 << 16
#: Quantiles that are found beside the count of rows; more take a job of their own.
GRID = 2048


def quantiles(df: DataFrame, order: str) -> list[int]:
    """Numbers that cut the rows, by ``order``, into ranges of about RANGE rows and never,
    unless they are equal, of over twice that."""
    cuts = lambda n: F.percentile_approx(order, [i / n for i in range(1, n)], max(10_000, 8 * n))
    found = df.agg(F.count(order).alias("rows"), cuts(GRID).alias("cuts")).first()
    ranges = -(-found["rows"] // RANGE)
    if ranges <= 1:
        return []
    if ranges > GRID // 2:
        return sorted(set(df.agg(cuts(ranges).alias("cuts")).first()["cuts"]))
    # every so many of the grid's cuts, rounded down
    return sorted({found["cuts"][k * GRID // ranges - 1] for k in range(1, ranges)})


def with_range(df: DataFrame, order: str, cuts: list[int], out: str = "_range") -> DataFrame:
    """Adds the number of cuts below or at each row's ``order``, found by halves."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    one = df.sparkSession.createDataFrame([(cuts,)], f"_cuts array<{df.schema[order].dataType.simpleString()}>")
    number = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("_cuts", low + step - 1) <= F.col(order), low + step).otherwise(low))
    return df.crossJoin(F.broadcast(one)).withColumn(out, number).drop("_cuts")


def prefix_sums(df: DataFrame, size: str, order: str = "ordinal", out: str = "offset", by: str | None = None) -> DataFrame:
    """Adds the sum of ``size`` over all rows before, in the order of a number that rows
    share with no other row; with ``by``, over those of the same file or other group.

    Ranges of the number are added up apart, and only their totals pass through one task.
    They are cut at quantiles of the number, so that each has RANGE rows or so however the
    numbers lie. Finding these is a job at once, which reads the number only."""
    kept = df.columns
    groups = [by] if by else []
    rows = with_range(df, order, quantiles(df, order))
    totals = rows.groupBy(*groups, "_range").agg(F.sum(size).alias("_total"))
    before = (Window.partitionBy(by) if by else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*groups, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_local", F.coalesce(F.sum(size).over(local), F.lit(0))).join(bases, [*groups, "_range"])
    return summed.select(*kept, (F.col("_local") + F.col("_base")).cast("long").alias(out))
