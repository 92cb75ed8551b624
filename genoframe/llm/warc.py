"""WARC archives of pages, written and read by Spark, with boundary-chain verification.

Writing. Each task writes archives of its own: a response record for a page, or a
revisit record without the payload where an earlier chosen page has an equal payload
of MIN_SHARED bytes or more. Pages are not shuffled unless very many are revisits.

Reading. Spark splits archives at a blank line followed by ``WARC/1.``. A header holds
no blank line, so none is ever cut, whatever its fields hold, but a payload may hold
the separator, so each piece is only a candidate for a record. A task emits the offset
of each piece and, where its header parses, of the successor that its length points
at, and follows these links within its split to where they leave it. Pointer jumping
from the start of each file then finds where the true chain enters every split,
doubling its stride each round, and the candidates on that chain are the records; magic
inside payloads is not reachable. Offsets within a split become offsets in the file by
adding up the lengths of the splits before. A file whose chain does not end where the
file ends is an error: no record is left out silently.

A payload that holds the separator comes in pieces. The pieces' owners are found from
offsets, without bytes, within each split; only the pieces of such records are then
shuffled and joined again. Sizes and SHA-1 sums are of the payloads as read, those of
revisits are of the record that they refer to.

Defined results: a null payload is empty; null urls have no target header; of equal
payloads the largest page id is the response, null ids being smaller than all others,
and of rows that repeat id and payload one; an empty table gives no archives. Archives
of other writers are read too: their records have a ``record_id`` and no ``page_id``.
Columns that are not named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.llm.scratch import Scratch, new_path

MIN_SHARED = 1000
#: Records of one archive.
RECORDS = 100_000
#: Rows up to which a table of ids is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
MAGIC = "WARC/1."
#: What stands between records, up to the version's last digit.
SEPARATOR = "\r\n\r\n" + MAGIC
_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def plan_records(pages: DataFrame, scratch: Scratch, key: str, url: str, html: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a unique ``row``, and the rows that revisit another page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    repeated = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR page_id IS NULL")
    if repeated.isEmpty():
        rows = rows.withColumn("row", F.col("page_id"))
    else:
        rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    sums = rows.select("page_id", "row", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes"))
    sums = scratch.table(sums.where(F.col("bytes") >= MIN_SHARED), "sums")
    first = sums.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.table(first, "first")
    again = sums.join(_small(first), ["digest", "bytes"]).where("row <> first.row")
    again = scratch.table(again.select("row", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row")), "revisits")
    scratch.drop(sums, first)
    return rows, again


def write_archives(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a record for every row; returns the archives' folder."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = path or new_path(spark, "archives")
    rows, again = plan_records(pages, scratch, key, url, html)
    joined = rows.join(_small(again), "row", "left")
    shared = F.col("refers_row").isNotNull()
    body = F.when(shared, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def page(number, row) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))

    record = F.concat(
        F.lit(MAGIC + "1\r\n"),
        line("WARC-Type", F.when(shared, "revisit").otherwise("response")),
        line("WARC-Record-ID", page(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        F.when(shared, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", page(F.col("refers_to"), F.col("refers_row"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )
    # the writer's line end is the second of the two that end a record
    record_file = joined.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS)
    record_file.text(path)
    scratch.drop(rows, again)
    return path


_header = re.compile(rb"[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n").match


def parse_header(piece: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Bytes of the header after the magic, bytes of the block, and the fields."""
    m = _header(piece)
    if not m:
        return None
    fields = {}
    for row in re.sub(rb"\r\n[ \t]+", b" ", m.group(1)).split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if colon:
            fields.setdefault(name.lower(), value.strip())
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return m.end(), int(length), fields


_page = re.compile(rb"<urn:page:(null|-?\d+):-?\d+>").fullmatch


def _number(value: bytes | None) -> int | None:
    m = _page(value or b"")
    return int(m.group(1)) if m and m.group(1) != b"null" else None


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def payload_of(block: bytes, kind: bytes) -> bytes:
    """What follows the HTTP header, if the block is an HTTP message; else the block."""
    return block.partition(b"\r\n\r\n")[2] if kind.startswith(b"application/http") else block


def declared_digest(value: bytes | None) -> str | None:
    """A header's SHA-1 in hex; it may be written in base 32."""
    algorithm, _, digest = (value or b"").partition(b":")
    if algorithm.lower() != b"sha1":
        return None
    if len(digest) == 32:
        try:
            return base64.b32decode(digest.upper()).hex()
        except ValueError:
            return None
    return _text(digest.lower())


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", SEPARATOR).text(path)
    about = [F.col(f"_metadata.{m}").alias(a) for m, a in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "size"))]
    return text.select(*about, F.col("value").cast("binary").alias("piece"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, bytes]]]]:
    """The file, split and size of rows that follow one another, with their pieces and
    the place of each piece's record from the split's first byte. A scan may pass over a
    separator that lies across two of its buffers, so rows are cut once more."""
    of, at = None, 0
    for batch in batches:
        held: list[tuple[int, bytes]] = []
        for file, split, size, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != (file, split, size):
                if held:
                    yield of, held
                of, at, held = (file, split, size), 0, []
                if split == 0 and row.startswith(MAGIC.encode()):
                    row, at = row[len(MAGIC) :], len(MAGIC)
            for piece in row.split(SEPARATOR.encode()):
                held.append((at - len(MAGIC), piece))
                at += len(piece) + len(SEPARATOR)
        if held:
            yield of, held


_CANDIDATE = (
    "file string, split long, at long, next long, leaves long, total long, size long, type string, record_id string, page_id long, target string, "
    "digest string, refers string, whole boolean, payload_bytes long, found string"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(n, _KINDS[t]) for n, t in (x.split() for x in _CANDIDATE.split(", "))]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece, with offsets from its split's first byte and, if it is a
    candidate, its link and fields; and one row without ``at`` for each split with the
    ``total`` of its bytes."""

    def closed(of: tuple, rows: list[list], total: int) -> pa.RecordBatch:
        """Each candidate's link followed to the first offset outside the split."""
        place = {r[2]: i for i, r in enumerate(rows) if r[3] is not None}
        for r in reversed(rows):
            if r[3] is not None:
                r[4] = rows[i][4] if (i := place.get(r[3])) is not None else r[3]
        rows = [*rows, [of[0], of[1], None, None, None, total, of[2], *[None] * 9]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])

    def row_of(of: tuple, at: int, piece: bytes) -> list:
        # a header that a payload with the magic follows ends in the separator
        head = parse_header(piece) or parse_header(piece + b"\r\n\r\n")
        if not head:
            return [*of[:2], at, *[None] * 13]
        begin, length, fields = head
        kind = fields.get(b"content-type", b"").lower()
        whole = begin + length in (len(piece), len(piece) - 4)
        payload = payload_of(piece[begin : begin + length], kind) if whole else None
        name = fields.get(b"warc-record-id")
        return [
            *of[:2], at, at + len(MAGIC) + begin + length + 4, None, None, None, _text(fields[b"warc-type"]), _text(name), _number(name), _text(fields.get(b"warc-target-uri")),
            declared_digest(fields.get(b"warc-payload-digest")), _text(fields.get(b"warc-refers-to")), whole,
            None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, total = None, [], 0
        for of, placed in _placed(batches):
            if now != of:
                if now:
                    yield closed(now, rows, total)
                now, rows = of, []
            rows += [row_of(of, at, piece) for at, piece in placed]
            total = placed[-1][0] + len(MAGIC) + len(placed[-1][1]) + len(SEPARATOR)
        if now:
            yield closed(now, rows, total)

    return _pieces(spark, path).mapInArrow(run, _CANDIDATE)


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``file`` and ``at`` where the chain from each file's start enters a split."""
    jumps = found.select("file", "at", "leaves")
    targets = found.select("file", F.col("leaves").alias("at")).distinct()
    starts = found.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    jumps = scratch.table(jumps.join(targets.union(starts).distinct(), ["file", "at"]), "jumps")
    known, count = scratch.table(starts, "known"), -1
    while (now := known.count()) != count:
        count = now
        over = known.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        before, known = known, scratch.table(known.union(over).distinct(), "known")
        twice = jumps.join(jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then")), ["file", "leaves"])
        nearer, jumps = jumps, scratch.table(twice.select("file", "at", F.col("then").alias("leaves")), "jumps")
        scratch.drop(before, nearer)
    scratch.drop(jumps)
    return known


@contextmanager
def same_splits(spark: SparkSession):
    """Files are dealt into the same splits however many executors there are, since two
    scans must agree on them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def check_ends(chain: DataFrame, sizes: DataFrame) -> None:
    """Raise unless every file's chain goes on to the file's end."""
    ends = chain.groupBy("file").agg(F.max("next").alias("end"))
    torn = sizes.join(ends, "file", "left").where("end IS NULL OR end <> size").limit(5).collect()
    if torn:
        raise ValueError("; ".join(f"{r['file']}: the records end at {r['end'] or 0} of {r['size']} bytes" for r in torn))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder's archives: ``file``, ``offset``, ``type``, ``record_id``,
    ``page_id``, ``target``, ``payload_bytes`` and ``payload_digest`` of the full payload,
    ``refers_to`` and ``verified`` (the stored payload has the header's digest; null for
    revisits and for records without one)."""
    scratch = Scratch(spark)
    with same_splits(spark):
        records = _records(spark, path, scratch)
    # a revisit's payload is the one of the record that it refers to
    wanted = records.where("type = 'revisit' AND refers IS NOT NULL").select(F.col("refers").alias("record_id")).distinct()
    first = records.where("type <> 'revisit'").select("record_id", "page_id", "payload_bytes", "found")
    first = first.join(wanted, "record_id").groupBy("record_id").agg(F.max(F.struct("page_id", "payload_bytes", "found")).alias("first"))
    first = scratch.table(first.select(F.col("record_id").alias("of"), "first"), "referred")
    rows = records.join(_small(first), F.col("refers") == F.col("of"), "left")
    again = F.col("type") == "revisit"
    stored = F.when(~again & F.col("digest").isNotNull(), F.col("found").eqNullSafe(F.col("digest")))
    return rows.select(
        "file", F.col("at").alias("offset"), "type", "record_id", "page_id", "target",
        F.when(again, F.col("first.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.coalesce("first.found", "digest")).otherwise(F.col("found")).alias("payload_digest"),
        F.when(again, F.col("first.page_id")).alias("refers_to"), stored.alias("verified"),
    )


def _records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    found = scratch.table(candidates(spark, path), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.where("at IS NULL").select("file", "split", "size", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    splits = scratch.table(splits, "splits")
    pieces = found.where("at IS NOT NULL").drop("total", "size").join(splits.drop("size"), ["file", "split"])
    pieces = scratch.table(pieces.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")}), "offsets")
    linked = pieces.where("next IS NOT NULL")
    entries = reachable(linked, scratch).withColumn("entry", F.lit(True))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """The candidates of a split on the chain from its entries."""
        at = rows["at"].tolist()
        after = dict(zip(at, rows["next"].tolist(), strict=True))
        on: set[int] = set()
        for x in rows.loc[rows["entry"].notna(), "at"].tolist():
            while x in after and x not in on:
                on.add(x)
                x = after[x]
        return rows.loc[[x in on for x in at], ["file", "at"]]

    links = linked.select("file", "split", "at", "next").join(entries, ["file", "at"], "left")
    chain = links.groupBy("file", "split").applyInPandas(walk, "file string, at long")
    records = scratch.table(linked.join(chain, ["file", "at"]).drop("leaves"), "records")
    check_ends(records, splits.groupBy("file").agg(F.max("size").alias("size")))
    scratch.drop(found)
    if records.where("NOT whole").isEmpty():
        scratch.drop(pieces, splits)
        return records
    sums = scratch.table(_joined(spark, path, records, pieces, splits, scratch), "sums")
    joined = records.join(sums, ["file", "at"], "left")
    joined = joined.withColumns({"found": F.coalesce("found", "sum"), "payload_bytes": F.coalesce("payload_bytes", "bytes")})
    return joined.drop("sum", "bytes")


def _joined(spark: SparkSession, path: str, records: DataFrame, pieces: DataFrame, splits: DataFrame, scratch: Scratch) -> DataFrame:
    """``file``, ``at``, ``sum`` and ``bytes`` of the payloads that came in pieces."""
    torn = records.where("NOT whole").select("file").distinct()
    heads = records.select("file", "split", "at", F.struct("at", "whole").alias("head"))
    # the record that a split begins in the middle of
    lasts = heads.groupBy("file", "split").agg(F.max("head").alias("last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.select("file", "split").join(lasts, ["file", "split"], "left").select("file", "split", F.last("last", True).over(earlier).alias("begun"))
    so_far = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = pieces.select("file", "split", "at", "base").join(torn, "file", "left_semi").join(heads, ["file", "split", "at"], "left").join(begun, ["file", "split"])
    owned = owned.withColumn("head", F.coalesce(F.last("head", True).over(so_far), "begun")).where("NOT head.whole")
    owned = scratch.table(owned.select("file", "split", (F.col("at") - F.col("base")).alias("local"), "at", F.col("head.at").alias("head")), "owned")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split, _), placed in _placed(batches):
            n = len(placed)
            columns = [pa.array([file] * n), pa.array([split] * n, pa.int64()), pa.array([a for a, _ in placed], pa.int64()), pa.array([p for _, p in placed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "local", "piece"])

    bytes_ = _pieces(spark, path).mapInArrow(place, "file string, split long, local long, piece binary").join(_small(owned), ["file", "split", "local"])

    def digest(rows: pd.DataFrame) -> pd.DataFrame:
        record = SEPARATOR.encode().join(rows.sort_values("at")["piece"].tolist())
        begin, length, fields = parse_header(record)
        payload = payload_of(record[begin : begin + length], fields.get(b"content-type", b"").lower())
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "at": [rows["head"].iloc[0]], "sum": [hashlib.sha1(payload).hexdigest()], "bytes": [len(payload)]})

    return bytes_.select("file", "head", "at", "piece").groupBy("file", "head").applyInPandas(digest, "file string, at long, sum string, bytes long")
