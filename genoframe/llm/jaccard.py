"""Documents linked by the Jaccard similarity of their five-word shingles.

The join filters by prefixes that demand several matches. All shingles have one
order: those not known as frequent by hash, then the frequent ones by count. Two
sets of similarity 0.8 or more share at least m of their shingles within the first
n - ceil(0.8 n) + m of each, for any m. A document takes the m that makes its
estimated cost least: rows to merge, by the counts of its prefix's frequent
shingles, and candidates to verify, of which m matches leave a share of 1 / m.
A pair must share the smaller of its two demands. Sizes and the positions of a
shared shingle must also allow the similarity.

Which shingles are frequent changes the cost only. They are counted over all
documents; the list is cut to FREQUENT entries, which bounds what is broadcast. What decides
on skew are exact counts of the buckets' rows, partly summed before they are shuffled: a
bucket of over HOT rows is dealt out in parts, whether its shingle is listed or not.

Links, not pairs, are wanted, so groups of copies aren't expanded:

1. Documents of equal sets are linked to the smallest id and go on as one.
2. In each shingle's bucket documents are paired with one leader, the one with the
   fewest rare shingles. Candidates are verified on whole texts. Frequent buckets
   are salted, and the leaders of their parts are paired in turn.
3. Connected components of these links are found, and then only pairs of different
   components in a bucket are left. Up to the end of the prefix that ends first every
   common shingle is known, so a pair must share there what that set cannot have beyond
   it. The pair's first common shingle is then early in both prefixes, which finds it,
   and all that they share there are counted before it is verified. How early follows from
   both sizes, so a shingle's documents are classed by size, each is met with the classes
   that it may be similar to, and only if it has the shingle early enough for that class.
   So documents that share a passage, but no more, form no pairs.

Verification sends each text once to each of its leaders; a leader's followers are
dealt out in parts of FOLLOWERS. No text is cut, and no bucket is capped.

Defined results: a null text or one without words has no shingles and links with
nothing; rows of one id are one node; a null id links with nothing and has a null
component; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.components import components
from genoframe.llm.scratch import Scratch, collected
from genoframe.llm.shingles import shingle_set

#: Similarity as a whole percentage, so that bounds are exact.
PERCENT = 80
FREQUENT = 1 << 17
#: Shingles of a task that are counted together, and the count from which one is reported.
COUNTED = 4_000_000
REPORTED = 3
LOW_BITS = np.uint64((1 << 22) - 1)
MAX_MATCHES = 4
VERIFY_COST = 12
BUCKET = 2048
FOLLOWERS = 64
#: Rows of a bucket from which it is dealt out in parts of BUCKET.
HOT = 4 * BUCKET
#: Sizes up to which each is a class of its own; beyond, a class spans a twentieth or so.
OWN_CLASS = 32
#: Rows up to which a table of ids is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A part's number is put over a shingle's hash from this bit on.
PART_BIT = 39


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents have, sorted, and how many have them.

    Counts order shingles, which any order would do, so they may leave out what a task saw
    fewer than REPORTED times among COUNTED shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[bytes] = set()

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= REPORTED
            return pa.RecordBatch.from_arrays([_signed(found[keep]), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    s = shingle_set(text)
                    # an exact copy adds nothing: copies go on as one document
                    if len(s) and (d := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                        if size >= COUNTED:
                            yield flush()
                            held, size = [], 0
                            seen.clear()
        if size:
            yield flush()

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def matches_wanted(costs: np.ndarray, base: int) -> int:
    """The m of least estimated cost; ``costs`` are the counts of the ordered set's
    shingles, ``base`` the length of the prefix for one match."""
    most = min(MAX_MATCHES, len(costs) - base + 1)
    sums = np.cumsum(costs[: base + most - 1])[base - 1 :]
    m = np.arange(1, most + 1)
    return int(np.argmin(sums * (1 + VERIFY_COST / m))) + 1


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each document: set size, digest, prefix (bucket and salt of each shingle, in
    order), matches wanted, and the number of its rare shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    fields = ["doc", "n", "d1", "d2", "rare", "wanted", "last_cost", "last_hash", "bucket", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        seen = np.zeros(int(LOW_BITS) + 1, bool)  # the low bits that frequent shingles have
        seen[(tokens & LOW_BITS).astype(np.int64)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                buckets, salts, ends = [], [], [0]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text)
                    n = len(s)
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    halves = [(h ^ 1 << 63) - (1 << 63) for h in divmod(digest, 1 << 64)]
                    cost = np.zeros(n, np.int64)
                    if n and len(tokens):
                        maybe = np.flatnonzero(seen[(s & LOW_BITS).astype(np.int64)])
                        i = np.minimum(np.searchsorted(tokens, s[maybe]), len(tokens) - 1)
                        known = maybe[tokens[i] == s[maybe]]
                        if len(known):
                            # the others are in order by their hash already
                            found, at_cost = s[known], counts[i[tokens[i] == s[maybe]]]
                            order = np.lexsort((found, at_cost))
                            rest = np.delete(s, known)
                            s = np.concatenate([rest, found[order]])
                            cost[len(rest) :] = at_cost[order]
                    rare, wanted = int((cost == 0).sum()), 1
                    if n:
                        base = n - (PERCENT * n + 99) // 100 + 1
                        wanted = matches_wanted(cost, base)
                        s, cost = s[: base + wanted - 1], cost[: base + wanted - 1]
                    # part 0 of a rare shingle; the parts of a frequent one are numbered from 1
                    parts = cost // BUCKET + 1
                    salt = np.where(cost > 0, 1 + (digest & 0xFFFFFF) % parts, 0).astype(np.uint64)
                    buckets.append(s ^ salt << np.uint64(PART_BIT))
                    salts.append(salt.astype(np.int32))
                    ends.append(ends[-1] + len(s))
                    # where the prefix ends in the order of all shingles
                    last = (int(cost[-1]), int(s[-1]) - (1 << 63)) if n else (0, 0)
                    rows.append((doc, n, *halves, rare, wanted, *last))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                offsets = pa.array(np.array(ends, np.int32))
                columns += [pa.ListArray.from_arrays(offsets, _signed(np.concatenate(buckets))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(salts)))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.select("doc", "text").mapInArrow(run, "doc long, n int, d1 long, d2 long, rare int, wanted int, last_cost long, last_hash long, bucket array<long>, salt array<int>")


def _small(df: DataFrame) -> DataFrame:
    """The table, broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the candidate pairs (``a``, its leader ``b``) that are similar, on whole texts."""
    pairs = scratch.table(pairs, "candidates")
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
    groups = scratch.table(groups, "leaders")
    leaders = groups.select(F.col("b").alias("doc"), F.col("b").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    followers = pairs.join(_small(groups), "b").select(F.col("a").alias("doc"), F.col("b").alias("leader"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("role"))
    roles = scratch.table(leaders.unionAll(followers), "roles")
    sent = docs.join(_small(roles), "doc").select("leader", "part", "role", "doc", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(n, "leader", "part").sortWithinPartitions("leader", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = [], []
                for leader, piece, role, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if group != (leader, piece):
                        group, own = (leader, piece), []
                    s = shingle_set(text)
                    if not role:
                        own.append(s)
                        continue
                    for o in own:
                        both = len(np.intersect1d(s, o, assume_unique=True))
                        if both and 100 * both >= PERCENT * (len(s) + len(o) - both):
                            a.append(doc)
                            b.append(leader)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = scratch.table(sent.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(pairs, groups, roles)
    return links


_FIT = (
    f"100 * least({{a}}.n, {{b}}.n) >= {PERCENT} * greatest({{a}}.n, {{b}}.n) AND "
    f"{100 + PERCENT} * (least({{a}}.pos, {{b}}.pos) + 1 + least({{a}}.n - {{a}}.pos, {{b}}.n - {{b}}.pos) - 1) >= {PERCENT} * ({{a}}.n + {{b}}.n)"
)


def early_enough(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of a shingle's documents, once for each class of sizes (``own`` is their class,
    ``other`` that one) in which it may be the first that they share with a similar one.

    Let t be what two similar sets share at least. If the document's own prefix ends first,
    at least t less what lies behind that prefix is shared within both, else t less what lies
    behind the other one's. The first is least for the smallest size of a class, the second for
    the largest."""
    own = F.when(F.col("n") < OWN_CLASS, F.col("n")).otherwise(OWN_CLASS + F.floor(20 * F.log(F.col("n") / OWN_CLASS))).cast("int")
    rest = rest.withColumn("own", own)
    classes = rest.groupBy("token", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("wanted").alias("least"))
    classes = scratch.table(classes.select(F.col("token").alias("of"), F.col("own").alias("other"), "low", "high", "least"), "classes")
    met = rest.join(_small(classes), F.col("token") == F.col("of")).where(f"100 * high >= {PERCENT} * n AND {PERCENT} * low <= 100 * n")
    met = met.withColumns({"low": F.expr(f"greatest(low, ({PERCENT} * n + 99) div 100)"), "high": F.expr(f"least(high, (100 * n) div {PERCENT})")})
    shared = f"({PERCENT} * (n + {{}}) + {99 + PERCENT}) div {100 + PERCENT}"
    first = f"{shared.format('low')} - (n - prefix)"
    behind = f"(({PERCENT} * high + 99) div 100 - least)"
    # of one size it is exact; over a range of sizes rounding may take one off
    second = f"{shared.format('high')} - {behind} - if(low = high, 0, 1)"
    return met.where(f"pos <= prefix - greatest(1, least({first}, {second}))").drop("of", "low", "high", "least")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    sets = scratch.table(prefixes(docs, frequent_shingles(docs)), "sets")

    # equal sets: all but the smallest id are linked to it and left out
    digest = ["d1", "d2", "n"]
    some = sets.where("n > 0 AND doc IS NOT NULL")
    first = some.groupBy(*digest).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    first = scratch.table(first, "firsts")
    copies = scratch.table(some.select("doc", *digest).join(_small(first), digest).where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")), "copies")
    scratch.drop(first)
    alone = some.join(_small(copies.select(F.col("a").alias("doc"))), "doc", "left_anti")

    # buckets of two or more, and all parts of frequent shingles
    entries = alone.select("doc", "n", "rare", "wanted", F.posexplode(F.arrays_zip("bucket", "salt")).alias("pos", "at"))
    entries = entries.select(F.col("at.bucket").alias("bucket"), F.col("at.salt").alias("salt"), "doc", "n", "rare", "wanted", "pos")
    hot = entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("parts")).where(f"parts > {HOT // BUCKET}")
    hot = scratch.table(hot.withColumnRenamed("bucket", "hot"), "hot")
    entries = entries.join(_small(hot), F.col("bucket") == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc"), "parts") + 1, F.lit(0)))
    of = Window.partitionBy("bucket", "part")
    entries = entries.withColumn("leader", F.min(F.struct("rare", "doc", "n", "pos")).over(of)).withColumn("size", F.count(F.lit(1)).over(of))
    entries = entries.where("size > 1 OR salt > 0 OR part > 0").drop("size")
    entries = entries.withColumn("token", F.expr(f"bucket ^ shiftleft(cast(salt AS bigint), {PART_BIT})"))
    entries = scratch.table(entries.select("token", "doc", "n", "rare", "wanted", "pos", "leader", F.expr("salt > 0 OR part > 0").alias("split")), "buckets")
    scratch.drop(hot)

    me = F.struct("n", "pos")
    stars = entries.where("leader.doc <> doc").withColumn("me", me).where(_FIT.format(a="me", b="leader")).select(F.col("doc").alias("a"), F.col("leader.doc").alias("b"))
    parts = entries.where("split").select("token", "leader").distinct()
    heads = parts.groupBy("token").agg(F.min("leader").alias("head"))
    heads = parts.join(heads, "token").where("head.doc <> leader.doc").where(_FIT.format(a="leader", b="head")).select(F.col("leader.doc").alias("a"), F.col("head.doc").alias("b"))
    links = verified(docs, stars.unionAll(heads).distinct(), scratch)

    # what is left: pairs of different components that share a bucket
    def settled(edges: DataFrame) -> DataFrame:
        """Their components as a table, without those that it was made from."""
        keep: list[str] = []
        with collected(spark, keep):
            table = scratch.table(components(edges, scratch=scratch), "components")
            keep.append(table._genoframe_path)
        return table

    found = settled(links)
    # of a prefix's shingles, those in a bucket of their own are in no set whose prefix ends later
    seen = entries.groupBy(F.col("doc").alias("of")).agg(F.count(F.lit(1)).alias("seen"))
    prefix = F.expr(f"n - (({PERCENT} * n + 99) div 100) + wanted")
    facts = alone.select("doc", "n", "wanted", "last_cost", "last_hash", prefix.alias("prefix")).join(_small(seen), F.col("doc") == F.col("of"))
    facts = facts.join(_small(found), F.col("doc") == F.col("node"), "left")
    facts = scratch.table(facts.select("doc", "n", "wanted", F.struct("last_cost", "last_hash").alias("last"), "prefix", (F.col("n") - F.col("prefix") + F.col("seen")).alias("most"), F.coalesce("component", "doc").alias("component")), "facts")
    rest = entries.select("token", "doc", "pos").join(_small(facts), "doc")
    mixed = rest.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    rest = scratch.table(rest.join(mixed, "token"), "mixed")
    scratch.drop(entries, facts, found)
    rest = early_enough(rest, scratch)
    a, b = rest.alias("a"), rest.alias("b")
    # what the set whose prefix ends first can share at most: all it has but what only its own bucket holds
    most = f"{100 + PERCENT} * if(a.last <= b.last, a.most, b.most) >= {PERCENT} * (a.n + b.n)"
    # common shingles up to the end of that prefix must number m, so the first of them has m - 1 behind it in both prefixes
    m = f"(({PERCENT} * (a.n + b.n) + {99 + PERCENT}) div {100 + PERCENT} - if(a.last <= b.last, a.n - a.prefix, b.n - b.prefix))"
    early = f"a.pos <= a.prefix - {m} AND b.pos <= b.prefix - {m}"
    pairs = a.join(b, F.expr("a.token = b.token AND a.own = b.other AND a.other = b.own AND a.doc > b.doc AND a.component <> b.component AND " + most + " AND " + early + " AND " + _FIT.format(a="a", b="b")))
    pairs = pairs.select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), F.expr(f"greatest({m}, least(a.wanted, b.wanted))").alias("m")).distinct()
    pairs = kept = scratch.table(pairs, "pairs")
    scratch.drop(rest)
    tokens = alone.select("doc", F.zip_with("bucket", "salt", lambda x, y: x.bitwiseXOR(F.shiftleft(y.cast("long"), PART_BIT))).alias("tokens"))
    pairs = pairs.join(tokens.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    pairs = pairs.where(F.size(F.array_intersect("x", "y")) >= F.col("m")).select("a", "b")
    more = verified(docs, pairs, scratch)

    found = settled(copies.unionAll(links).unionAll(more))
    scratch.drop(copies, links, more, kept)
    out = sets.select("doc", "n").join(found, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
