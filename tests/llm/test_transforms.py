"""Fill-in-the-middle, token files and the Merkle manifest against plain versions."""

import glob
import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoframe.llm import fim, queries
from genoframe.llm.merkle import folded, leaf_digest, levels_of, manifest, proof
from genoframe.llm.tokens import read_documents, read_span, read_tokens, shard_table, with_crc32, write_tokens

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- fill in the middle ----------------------------------------------------------
def plain_middle(key, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"42:{'' if key is None else key}")
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if d % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab <>PSM\t\n\x0b\x0c\r\x1c\x85  é漢😀́\0")), max_size=60), st.integers(-5, 10**12))
def test_middle_of_any_text(text, key):
    n, form, before, inside, out = fim.transform(text.encode(), fim.choices(42, str(key)))
    assert (n, form, before, inside, out.decode()) == plain_middle(key, text)


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 1000])
def test_ranked_bits(size):
    bits = [i for i in range(size) if random.Random(size + i).random() < 0.3 or i == size - 1]
    x = sum(1 << i for i in bits)
    assert [fim.place_of(x, k, size) for k in range(1, len(bits) + 1)] == bits


def test_middles_of_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " ", " \n\t", "a", "a ", " <P> b", "x<S>", "<M>", "ends with <", "<S", "é" * 9 + " ü", "same text here"] + ["".join(rng.choice("ab c\n漢<") for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += ["same text here", "word " * 300_000 + " end ", "漢" * 200_000]
    rows = [(i if i % 50 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[12], rows[12]], "doc_id long, text string, output string, n long").repartition(3)
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()), key=str)
    want = sorted(((k, *plain_middle(k, t), t or "") for k, t, _, _ in [*rows, rows[12], rows[12]]), key=str)
    assert got == want and {x[2] for x in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


# -- token files -----------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, library, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "Über", "naïve", "x1", "漢字", "the", "of", "\n", "!!", "<|endoftext|>"]
    texts = [None, "", "   "] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["the word " * 60_000]
    keys = [*range(len(texts) - 1, 0, -1), None]
    rows = list(zip(keys, texts, range(len(texts)), strict=True)) + [(7, "the same", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long").repartition(5)
    path = write_tokens(docs, f"file://{tmp_path}/t", queries.tokenizer_path(), shards=3, row_group=1 << 16, page_rows=100)
    want = sorted(((k, [*library(t), 2]) for k, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [k for k, _ in want]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((k or -1, x) for k, x in want)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    shards = shard_table(spark, path).orderBy("shard").collect()
    assert len(shards) == 3 and sum(s["rows"] for s in shards) == len(rows) and sum(s["tokens"] for s in shards) == at
    # sums, pieces of documents and of the whole run of ids
    sums = {(r["start"], r["ids_crc32"]) for r in with_crc32(read_tokens(spark, path)).collect()}
    assert sums == {(r["start"], zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))) for r in got}
    some = read_documents(spark, path, [7, 100, 2999])
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in got if r["doc_id"] in (7, 100, 2999))
    flat = [i for r in got for i in r["ids"]]
    for low, high in ((0, 10), (shards[0]["tokens"] - 40, shards[0]["tokens"] + 40), (500, 500), (at - 3, at + 9), (100, 9000)):
        pieces = read_span(spark, path, low, high).orderBy("start").collect()
        assert [i for r in pieces for i in r["ids"]] == flat[low:high] and (not pieces or pieces[0]["start"] == low)


def test_token_files_prune(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: F.hash(x, "id").cast("string"))).alias("text"))
    path = write_tokens(docs, f"file://{tmp_path}/t", queries.tokenizer_path(), shards=2, row_group=1 << 17, page_rows=50)
    for file in glob.glob(f"{tmp_path}/t/tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 2
        by_name = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
        for c in ("key", "start", "stop", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in by_name[c].encodings and "RLE_DICTIONARY" not in by_name[c].encodings
        assert all(c.has_offset_index for c in by_name.values()) and by_name["start"].has_column_index

    def scanned(df):
        """Rows that the scan of ids gave, by its metric, and what it was planned to read."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        scans = []

        def walk(node):
            if node.nodeName().startswith("Scan parquet") and "ids" in node.schema().simpleString():
                scans.append(node.metrics().apply("numOutputRows").value())
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                walk(node.executedPlan())
            if node.getClass().getSimpleName().endswith("QueryStageExec"):
                walk(node.plan())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
        return sum(scans), text

    rows, text = scanned(read_documents(spark, path, [1234]))
    assert 1 <= rows <= 200 and "PushedFilters: [In(key, [1234])" in text or "EqualTo(key,1234)" in text
    rows, _ = scanned(read_span(spark, path, 20_000, 20_100))
    assert 1 <= rows <= 400
    _, text = scanned(read_tokens(spark, path).select("doc_id", "start"))
    assert "ids" not in text.partition("ReadSchema")[2].partition("\n")[0]


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = write_tokens(docs, f"file://{tmp_path}/t", queries.tokenizer_path())
    assert read_tokens(spark, path).collect() == [] == read_span(spark, path, 0, 9).collect()
    one = spark.createDataFrame([("k", "a b", 1)], "k string, text string, ids int")
    path = write_tokens(one, f"file://{tmp_path}/u", queries.tokenizer_path(), key="k", end_id=None)
    assert [(r["k"], r["n_tokens"]) for r in read_tokens(spark, path, "k").collect()] == [("k", 2)]


# -- Merkle manifest --------------------------------------------------------------
def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes, fanout):
    """The top, and of each node the siblings before and after it, level by level."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for i in below[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            held.append([i for x in below[at : at + fanout] for i in x])
        nodes, below = up, held
    return nodes[0], paths


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, over in zip(order, upper, strict=True):
        top, paths = trees[g]
        for (k, leaf), path in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), paths, strict=True):
            out.append((k, leaf, top, root, [*path, *over]))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["de", "en", "en", "en", "fr", None, "é", "z"]), f"text {i} é"[: rng.randrange(9)]) for i in range(137)]
    rows += [(200, "one", "alone"), (5, "en", "a key again"), (None, "en", None), (None, None, ""), (300, "en", "same"), (300, "en", "same"), (301, "", "x" * 100_000)]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, g long, path string").repartition(4)
    found = manifest(docs, ["doc_id", "lang", "text"], fanout=fanout, also={"len": F.length("text")})
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path", "len"]
    got = found.withColumn("again", folded(F.col("leaf"), F.col("path"))).withColumn("proof", proof(F.col("path"))).collect()
    flat = lambda rows: sorted(((k, leaf, top, root, tuple(map(tuple, path))) for k, leaf, top, root, path in rows), key=str)
    assert flat(tuple(r)[:5] for r in got) == flat(plain_manifest(rows, fanout))
    assert all(r["again"] == r["root"] and r["proof"] == "".join(a + b for a, b in r["path"]) for r in got)


def test_manifest_of_little(spark):
    schema = "doc_id long, lang string, text string"
    assert manifest(spark.createDataFrame([], schema), ["doc_id", "text"]).collect() == []
    (one,) = manifest(spark.createDataFrame([(1, None, "a")], schema), ["doc_id", "text"]).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == plain_leaf(1, "a") and one["path"] == []
    two = manifest(spark.createDataFrame([(1, None, "a"), (2, "x", "b")], schema), ["doc_id", "text"]).orderBy("doc_id").collect()
    assert two[0]["root"] == two[1]["root"] == sha(plain_leaf(1, "a") + plain_leaf(2, "b")) and two[0]["path"] == [("", plain_leaf(2, "b"))]
    assert [levels_of(n, 2) for n in (0, 1, 2, 3, 4, 5)] == [0, 0, 1, 2, 2, 3]
    # a field's length stands before it, so text can't pass from one field to another
    pair = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string").select(leaf_digest(F.col("x"), F.col("y")).alias("h")).collect()
    assert pair[0]["h"] != pair[1]["h"]


def test_tampering_shows(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") * 3).alias("n"))
    whole = manifest(docs, ["doc_id", "n"])
    forged = docs.select("doc_id", leaf_digest(F.col("doc_id"), F.when(F.col("doc_id") == 17, 0).otherwise(F.col("n"))).alias("given"))
    bad = whole.join(forged, "doc_id").where(folded(F.col("given"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in bad] == [17]
