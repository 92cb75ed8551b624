"""Every query of the subpackage on the smallest tables: columns, types, folds, and results
against DuckDB or a plain single-process version."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard

from genoframe.llm import language, queries, toxicity
from tests.llm.test_tables import union
from tests.llm.test_texts import brute_components, grams, weighted

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {
    "op1_chat": {"conv_id": "bigint", "call_id": "string", "position": "bigint", "tool": "string", "status": "string", "valid": "boolean", "canonical": "string"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op8_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_fim": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op12_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op13_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}
_found: dict[str, list] = {}


@pytest.fixture
def rows(spark):
    """A query's rows, from one run, whose columns and types are checked."""

    def run(name):
        if name not in _found:
            df = queries.QUERIES[name](spark, SF)
            kinds = dict(df.dtypes)
            assert TYPES[name].items() <= kinds.items()
            _found[name] = df.collect()
        return _found[name]

    return run


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_all_are_listed():
    assert set(queries.QUERIES) == set(TYPES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(rows, duck, name):
    got = rows(name)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got[0].asDict()) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_tool_calls_stand_behind_what_they_wait_for(rows):
    import json

    at = {(r["conv_id"], r["call_id"]): r["position"] for r in rows("op1_chat")}
    late = [(r["conv_id"], r["position"], at[r["conv_id"], d]) for r in rows("op1_chat") if r["valid"] for d in json.loads(r["canonical"])["depends_on"]]
    assert late and all(own > other for _, own, other in late)


def test_bpe(rows, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    assert {tuple(r) for r in rows("op3_bpe")} == {(i, len(x), sha(" ".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False))) for i, x in want.items()}


def test_tokens(rows, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want, at = set(), 0
    for i, x in sorted(texts.items()):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows("op12_tokens")} == want


def plain_language(text, dictionaries):
    """Sizes under each dictionary, one compressor at a time."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = language.letters(text)
    sizes = {}
    for name, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
        sizes[name] = sum(len(one.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES))
    best = min(sizes, key=lambda k: (sizes[k], k))
    return best, 1 / sum(math.exp((sizes[best] - s) / 2) for s in sizes.values())


def test_language(spark, rows, texts, duck):
    (dictionaries,) = queries.learned_languages(queries.table(spark, SF, "documents")).slices()
    learned = {x for x, _ in duck.sql("SELECT lang, doc_id FROM documents WHERE lang IS NOT NULL").fetchall()}
    got = rows("op5_language")
    assert set(dictionaries) == learned and {r["doc_id"] for r in got} == set(texts)
    for r in got:
        name, score = plain_language(texts[r["doc_id"]], dictionaries)
        assert (r["held_out"], r["lang_pred"]) == (fold(r["doc_id"], 4) == 2, name) and math.isclose(r["score"], score)


def test_embeddings(rows, duck):
    vectors = duck.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    good = [(i, np.array(v, dtype=float), y) for i, v, y in vectors if y is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    links = {(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93}
    group = union([i for i, _, _ in vectors], links)
    n = Counter(i for pair in links for i in pair)
    assert sorted(tuple(r) for r in rows("op6_embeddings")) == sorted((i, n[i], group[i], group[i] == i) for i, _, _ in vectors)


def plain_passages(texts, items):
    """The most similar window of each item in each document that shares a shingle with it."""
    out = {}
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    sets = {k: {d: set(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for d, w in words.items()} for k in range(1, 6)}
    for i, x in items:
        y = (x or "").encode().lower().split()
        if not y:
            continue
        g, k = grams(y), min(5, len(y))
        for d, w in words.items():
            if len(w) < k or sets[k][d].isdisjoint(g):
                continue
            all_grams, width = [tuple(w[s : s + k]) for s in range(len(w) - k + 1)], min(len(y), len(w)) - k + 1
            own = set(g)
            starts = [s for s in range(len(all_grams) - width + 1) if not own.isdisjoint(all_grams[s : s + width])]
            best = max((weighted(all_grams[s : s + width], g) for s in starts), default=0)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(rows, texts, duck):
    want = plain_passages(texts, duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows("op7_decontaminate")} == want


def test_shards(rows, texts, duck):
    got = rows("op8_shards")
    body = {i: (t or "").encode() for i, t in texts.items()}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(b) + 1, zlib.crc32(b)) for i, b in body.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    total = Counter(source.values())
    for s in sizes:
        own = Counter(source[r["doc_id"]] for r in got if r["shard"] == s)
        assert all(abs(own[x] - n / 16) < 2 for x, n in total.items())


def test_jaccard(rows, texts):
    want = brute_components(sorted(texts.items()))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows("op9_jaccard")} == want


def plain_toxicity(text, model):
    """Marginals by forward and backward sums over two states, a token at a time."""
    if model.score is None:
        return 0.0
    e = [model.emission(w) for w in toxicity.words_of((text or "").lower())]
    step = np.exp(model.moves)
    forward, backward = [], [np.ones(2)]
    for t, x in enumerate(e):
        own = np.array([1.0, math.exp(max(-60, min(60, x)))])
        forward.append(own if t == 0 else own * (forward[-1] @ step))
        forward[-1] /= forward[-1].sum()
    for x in e[:0:-1]:
        b = step @ (np.array([1.0, math.exp(max(-60, min(60, x)))]) * backward[-1])
        backward.append(b / b.sum())
    both = [f * b for f, b in zip(forward, backward[::-1], strict=True)] if e else []
    odds = np.array([b[1] / b[0] for b in both])
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.array(toxicity.summary(odds)) @ model.score)))))


def test_toxicity(spark, rows):
    """On the next larger tables, since these have labels enough for a field."""
    larger = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, larger, "documents"), queries.table(spark, larger, "labels")
    model, texts = queries.learned_toxicity(docs, labels), {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert {r["score"] for r in rows("op10_toxicity")} and model.score is not None
    got = queries.op10_toxicity(spark, larger).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in got:
        score = plain_toxicity(texts[r["doc_id"]], model)
        assert math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-9)
        assert (r["held_out"], r["predicted"]) == (fold(r["doc_id"], 5) == 0, int(r["score"] >= 0.5))
        assert all(0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) for s in r["spans"])


def test_pipeline(spark, texts, duck):
    """Each stage in turn by the plain versions, on what the one before kept."""
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    docs = queries.table(spark, SF, "documents")
    model = queries.learned_toxicity(docs, queries.table(spark, SF, "labels"))
    kept = {i: x for i, x in texts.items() if plain_toxicity(x, model) < 0.5}
    (dictionaries,) = queries.learned_languages(docs.where(docs["doc_id"].isin(list(kept)))).slices()
    codecs = language.Compressors(dictionaries)
    kept = {i: x for i, x in kept.items() if codecs.predict(x)[2]}
    kept = {i: kept[i] for i, (_, group) in brute_components(sorted(kept.items())).items() if i == group}
    leaks = {d for d, _ in plain_passages(kept, duck.sql("SELECT item_id, text FROM benchmark").fetchall())}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "n_tokens", "ids", "decoded_sha256"]
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: t.encode(x, add_special_tokens=False).ids for i, x in kept.items() if i not in leaks}
