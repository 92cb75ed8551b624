"""Operators on texts against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from genoframe.llm import language, shingles, toxicity
from genoframe.llm.bpe import WordBpe, bpe_decode, bpe_encode
from genoframe.llm.decontaminate import clean_documents, find_passages
from genoframe.llm.jaccard import jaccard_components
from genoframe.llm.queries import tokenizer_path
from genoframe.llm.sharding import SEED, assign_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def words(rng, n, letters="abcdefghij"):
    return [rng.choice(letters) + rng.choice(letters) + rng.choice("xyz") for _ in range(n)]


# -- BPE -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, library):
    texts = [None, "", " ", "The quick brown fox", "don't I'LL we've", "x<|endoftext|>y<|startoftext|>", "ΣΑΣ naïve café 🙂🙂 日本語", "a" * 900, "word " * 3000, "a\x85b\x1cc 12½ ²", "THE end!!! $$$%%%", "é" * 70]
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids array<int>")
    got = {r["doc_id"]: r for r in bpe_encode(df, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    again = {r["doc_id"]: r["decoded"] for r in bpe_decode(bpe_encode(df, tokenizer_path(), decode=False), tokenizer_path()).collect()}
    assert again == {i: r["decoded"] for i, r in got.items()}
    assert bpe_encode(df.limit(0), tokenizer_path()).count() == 0


def test_every_code_point(library):
    """Each in a word, alone and doubled: classes and lower case are the library's."""
    import json

    with open(tokenizer_path()) as f:
        bpe = WordBpe(json.load(f))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    texts = ["".join(f"a{chr(c)}1{chr(c)}{chr(c)}b " for c in points[i : i + 8]) for i in range(0, len(points), 8)]
    wrong = [t for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if bpe.encode(t) != want.ids]
    assert not wrong


def test_added_tokens_are_the_files():
    import json

    with open(tokenizer_path()) as f:
        spec = json.load(f)
    spec["added_tokens"] = [{"id": 7, "content": "[X]"}]
    assert 7 in WordBpe(spec).encode("a[X]b") and WordBpe(spec | {"added_tokens": []}).encode("a[X]b") == WordBpe(spec).encode("a[x]b")


def test_scan_equals_heap():
    import json

    with open(tokenizer_path()) as f:
        bpe = WordBpe(json.load(f))
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 60)))
        assert bpe.scan(bpe.start(word)) == bpe.heaped(bpe.start(word))


# -- language --------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(1)
    sound = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["ung", "sch", "ei", "ö", "ich"], "cc": ["eau", "é", "oux", "que", "an"]}
    text = lambda k, n: " ".join("".join(rng.choice(sound[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, rng.randrange(5, 200)), k, None, None) for i, k in enumerate(list(sound) * 60)]
    odd = [(1000, None, "aa", None, None), (1001, "", "aa", None, None), (1002, "123 !!", "aa", None, None), (1003, text("bb", 60), None, None, None)]
    df = docs_of(spark, rows[:120] + odd)
    dictionaries = language.fit_dictionaries(df)
    assert sorted(dictionaries) == ["aa", "bb", "cc"] and all(len(d) <= language.DICT_BYTES for d in dictionaries.values())
    test = docs_of(spark, rows[120:] + odd).withColumnRenamed("lang", "score")
    got = {r["doc_id"]: r for r in language.identify(test, dictionaries).collect()}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rows[120:]) >= 58
    assert all(tuple(got[i])[1:] == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(test, {}).collect()} == {"und"}
    assert language.fit_dictionaries(df.limit(0)) == {}


def test_slices_of_languages(spark, monkeypatch):
    """Languages that are compared in slices give what all of them together do."""
    rng = random.Random(2)
    sound = {f"l{k:02d}": [rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice(["", "n", "rt"]) for _ in range(5)] for k in range(11)}
    text = lambda k, n: " ".join("".join(rng.choice(sound[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, rng.randrange(5, 90)), k, None, i) for i, k in enumerate(list(sound) * 12)] + [(900, None, "l00", None, 1), (901, "77", "l01", None, 2)]
    docs = docs_of(spark, rows)
    everything = language.fit_dictionaries(docs)
    whole = sorted(map(tuple, language.identify(docs, everything).collect()))
    kept = sorted(map(tuple, language.drop_unknown(docs, everything).collect()))
    assert len(everything) == 11 and 0 < len(kept) < len(rows)
    for size in (1, 3, 11):
        monkeypatch.setattr(language, "SLICE", size)
        learned = language.Learned(docs)
        assert [len(x) for x in learned.slices()] == [min(size, 11 - at) for at in range(0, 11, size)]
        got = sorted(map(tuple, language.identify(docs, learned).collect()))
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in whole]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, whole, strict=True))
        assert sorted(map(tuple, language.drop_unknown(docs, learned).collect())) == kept


# -- toxicity --------------------------------------------------------------------
def toxic_texts(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, bad = words(rng, rng.randrange(20, 80)), i % 4 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumble", "snarl", "zokka" + rng.choice("abcdef") + "l"]))
        rows.append((i, " ".join(w).capitalize(), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, None), (9001, "", None), (9002, "1 2 3", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(None, 1), (5, None), (9000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = rows[400:]
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in held) >= len(held) - 2
    assert all(got[i]["score"] < 0.5 and not got[i]["spans"] for i in (9000, 9001, 9002))
    for i, t, y in held:
        for s in got[i]["spans"]:
            assert y and re.fullmatch(r"(?i)(grumble|snarl|zokka\w+)( (grumble|snarl|zokka\w+))*", t[s["start"] : s["end"]])
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_chain_equals_enumeration():
    import itertools

    import numpy as np

    moves, e = np.log([[0.9, 0.1], [0.4, 0.6]]), [np.array([-1.0, 2.0, 0.5, -3.0]), np.array([0.3])]
    for emissions, odds in zip(e, toxicity.odds_of(e, moves), strict=True):
        total, on = 0.0, np.zeros(len(emissions))
        for path in itertools.product((0, 1), repeat=len(emissions)):
            w = np.exp(sum(x * y for x, y in zip(emissions, path, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            on += w * np.array(path)
        assert np.allclose(odds / (1 + odds), on / total)


def test_slopes_are_the_likelihoods():
    """Of emissions and of transitions, against differences of the likelihood by enumeration."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    e, moves = [rng.normal(size=n) for n in (5, 1, 3)], rng.normal(size=(2, 2))
    gold = [rng.random(len(x)) < 0.5 for x in e]

    def value(e, moves):
        score = lambda x, path: sum(a * b for a, b in zip(x, path, strict=True)) + sum(moves[int(a), int(b)] for a, b in itertools.pairwise(path))
        return sum(score(x, g) - np.log(sum(np.exp(score(x, p)) for p in itertools.product((0, 1), repeat=len(x)))) for x, g in zip(e, gold, strict=True))

    got, slopes, by_move = toxicity.likelihood(e, gold, moves)
    assert np.isclose(got, value(e, moves))
    h = 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = h
        assert np.isclose(by_move[i, j], (value(e, moves + step) - value(e, moves - step)) / (2 * h), atol=1e-5)
    for k, x in enumerate(e):
        for t in range(len(x)):
            up, down = [v.copy() for v in e], [v.copy() for v in e]
            up[k][t] += h
            down[k][t] -= h
            assert np.isclose(slopes[k][t], (value(up, moves) - value(down, moves)) / (2 * h), atol=1e-5)


def test_transitions_are_learned():
    """Toxic words come in runs in these texts, so staying toxic weighs more than turning so."""
    rng = random.Random(9)
    bad = [" ".join([*words(rng, 20), *rng.choices(["grumble", "snarl", "zokkal"], k=4), *words(rng, 20)]) for _ in range(80)]
    model = toxicity.fit_field(bad, [" ".join(words(rng, 44)) for _ in range(160)])
    assert model.moves[1, 1] > model.moves[0, 1] + 1
    scorer = toxicity.Scorer(model)
    assert scorer.scores([bad[0], " ".join(words(rng, 44)), None])[0] > 0.9 > 0.1 > max(scorer.scores([" ".join(words(rng, 44)), None]))


# -- n-gram Jaccard join ---------------------------------------------------------
def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=80):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(rng, n=150):
    """Documents, edited copies, passages that many share, and short ones."""
    passage, rows = words(rng, 30), []
    bases = [words(rng, rng.randrange(1, 70)) for _ in range(n // 6)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(("NEW", "new", "Other", f"w{i}"))
        if rng.random() < 0.3:
            w += passage
        rows.append((i, rng.choice((" ", "  ", "\n")).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    from genoframe.llm import jaccard

    rng = random.Random(seed)
    rows = [*copies(rng), (900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one TWO"), (905, "x" * 5000), (906, "É a b"), (907, "é a b")]
    if seed == 2:  # with parts, chunks and shuffles as for large inputs
        monkeypatch.setattr(jaccard, "BUCKET", 3)
        monkeypatch.setattr(jaccard, "HOT", 6)
        monkeypatch.setattr(jaccard, "OWN_CLASS", 8)
        monkeypatch.setattr(jaccard, "FOLLOWERS", 2)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame([(i, t, "e", 7) for i, t in rows], "doc_id long, text string, component string, n int").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("own_class", [4, 32])
def test_shared_passages_of_many_sizes(spark, own_class, monkeypatch):
    """Documents around the threshold whose sizes differ, with shared passages in all."""
    from genoframe.llm import jaccard

    monkeypatch.setattr(jaccard, "OWN_CLASS", own_class)
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "BUCKET", 2)
    rng = random.Random(own_class)
    passages = [words(rng, n) for n in (8, 12, 20, 40)]
    rows = []
    for i in range(400):
        w = list(rng.choice(passages)) + words(rng, rng.randrange(0, 12))
        w = words(rng, rng.randrange(0, 4)) + w + (rng.choice(passages) if rng.random() < 0.5 else [])
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) < 380


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share eight words and no more, which none of the joins may pair with each other."""
    from genoframe.llm import jaccard

    kept = []
    whole = jaccard.early_enough
    monkeypatch.setattr(jaccard, "early_enough", lambda rest, scratch: kept.append((rest.count(), whole(rest, scratch).count())) or whole(rest, scratch))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id", F.lit(" b1 b2 b3 b4 b5 b6 b7 b8")).alias("text"))
    assert jaccard_components(df).where("doc_id <> component_id").count() == 0
    assert kept[0][0] >= 3000 and kept[0][1] == 0


def test_jaccard_odd_rows(spark):
    text = " ".join(words(random.Random(4), 40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 36, 1), (1, 36, 1), (2, 36, 1), (None, 36, None), (3, 0, 3)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


# -- decontamination -------------------------------------------------------------
def weighted(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def grams(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((40, 25, 25, 12, 6, 3))] + [(50, None), (51, ""), (52, "rare tail of four")]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 60))
        if i % 3 == 0:
            own = items[i // 3 % 6][1].upper().split()
            if i % 2 and len(own) > 20:
                own[rng.randrange(2, len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, items[0][1].rsplit(" ", 4)[0])]
    want = set()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, x in items:
            y = (x or "").split()
            if y and w and min(5, len(y)) <= len(w):
                k = min(len(y), len(w))
                g = grams(y)
                best = max(weighted(grams(w[s : s + k]), g) if len(y) >= 5 else float(w[s : s + k] == y) for s in range(len(w) - k + 1))
                if best >= 0.8:
                    want.add((d, i, round(best, 9)))
    docs = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in find_passages(docs, bench).collect()}
    assert got == want and any(s < 1 for _, _, s in want)
    from genoframe.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in find_passages(docs, bench).collect()} == want
    assert {r["doc_id"] for r in clean_documents(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    monkeypatch.undo()
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    assert find_passages(docs, bench.limit(0)).count() == 0 and find_passages(docs.limit(0), bench).count() == 0


def test_blocks_find_all_within_radius():
    import numpy as np

    from genoframe.llm.decontaminate import BLOCKS, NEAR, RADIUS, Items

    rng = np.random.default_rng(1)
    items = Items(9, list(range(40)), rng.integers(1 << 63, size=(40, 5)).astype(np.uint64))
    for _ in range(300):
        one = int(rng.integers(40))
        bits = np.unpackbits(items.prints[one])
        bits[rng.choice(64, RADIUS, replace=False)] ^= 1
        other = rng.integers(0, 256, BLOCKS, dtype=np.uint8)
        w, item = items.lookup(np.array([np.packbits(bits), other]))
        assert one in item[w == 0]
        close = np.bitwise_count(items.prints ^ other).astype(int) <= NEAR
        assert set(item[w == 1]) == set(np.flatnonzero(close.any(1)))
    assert NEAR * BLOCKS < RADIUS


# -- sharding --------------------------------------------------------------------
def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 9 == 0 else "é" * rng.randrange(40), "hot" if i % 2 else rng.choice(("a", "b", None))) for i in range(211)]
    rows += [rows[5]] * 6
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, shard int").repartition(5)
    got = assign_shards(df, 7).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    for s in range(7):
        own = [r for r in got if r["shard"] == s]
        assert len(own) in (31, 31) or abs(len(own) - len(rows) / 7) < 1
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for source in ("hot", "a", None):
            share = sum(r[2] == source for r in rows) / 7
            assert abs(sum(r["source"] == source for r in own) - share) <= 2
    assert [tuple(r) for r in assign_shards(df, 7).orderBy("shard", "slot").collect()] == [tuple(r) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert assign_shards(df.limit(0), 7).count() == 0 and len(assign_shards(df.limit(3), 7).collect()) == 3


def test_words_are_bytes_between_ascii_spaces():
    assert shingles.words_of("A b\x0bC\x1cd É") == ["a b".encode(), b"c\x1cd", "É".encode()]


def test_shards_dont_depend_on_partitions(spark):
    """The law by plain sorting, however the rows are stored."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a", "é" * i, "same"]), rng.choice(["x", "x", "x", "y", None, "-"])) for i in range(300)]
    rows += [rows[3]] * 3 + [(None, "t", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda x: "-" if x is None else f"={x}"
    hashed = [(sha(f"{SEED}|{part(k)}|{part(t if t is None else sha(t))}|{part(s)}"), k, t, s) for k, t, s in rows]
    by_source = {}
    for r in sorted(hashed, key=lambda r: r[0]):
        by_source.setdefault(r[3], []).append(r)
    order = sorted(((i + 0.5) / len(own), r[0], r) for own in by_source.values() for i, r in enumerate(own))
    want = []
    for at, (_, _, (_, k, t, s)) in enumerate(order):
        shard = at * 7 // len(rows)
        want.append((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s, shard, at - -(-shard * len(rows) // 7)))
    for n in (1, 3, 11):
        assert sorted((tuple(r) for r in assign_shards(df.repartition(n), 7).collect()), key=str) == sorted(want, key=str)
