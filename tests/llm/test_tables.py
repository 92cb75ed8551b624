"""Operators on pages, vectors and conversations, graphs, and the pipeline."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.llm.chat import link_calls, turns_as_calls
from genoframe.llm.components import components
from genoframe.llm.embeddings import near_duplicates, plan_tables
from genoframe.llm.urls import fit_rules, host_and_path, judge, page_edges
from genoframe.llm.warc import read_archives, write_archives


def union(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)] + [(5, 5)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(df).collect()} == union(ends, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


# -- WARC ------------------------------------------------------------------------
@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, old)


def pages_with_magic():
    evil = "x" * 900 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99:99>\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://c/WARC/1.0?x=WARC/1.1", evil * 3), (4, "u", "é" * 700), (5, "u", "é" * 700), (5, "u", "é" * 700), (None, "u\r\nX: y", "é" * 700)]
    rows += [(6, "WARC/1.", "WARC/1."), (7, "u", "WARC/1.\r\n\r\nWARC/1.1\r\n" * 3000), (8, "s", "same"), (9, "s", "same"), (10, "http://" + "WARC/1.1/" * 4000, evil), (11, "e", "line\r\n"), (12, "e", "\r\n\r\n\r\n")]
    rows += [(100 + i, f"http://x/WARC/1.{i}" if i % 9 == 0 else f"http://x/{i}", f"p{i} " * (i % 700) + "\r\n" * (i % 4)) for i in range(200)]
    return rows


@pytest.mark.parametrize("size", [20_001, 100_000_000])
def test_warc(spark, split_bytes, size):
    rows = pages_with_magic()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(3)
    split_bytes(size)
    got = read_archives(spark, write_archives(df)).collect()
    sums = lambda rows: sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got), key=str) == sums(rows)
    assert all(r["verified"] is not False for r in got)
    shared = sorted(((r["page_id"], r["type"], r["refers_to"]) for r in got if r["type"] == "revisit"), key=str)
    assert shared == sorted([(4, "revisit", 5), (5, "revisit", 5), (None, "revisit", 5)], key=str)
    assert sorted(r["target"] for r in got if r["target"] and "WARC" in r["target"]) == sorted(u for _, u, _ in rows if u and "WARC" in u)
    assert read_archives(spark, write_archives(df.limit(0))).count() == 0


def test_warc_at_every_buffer_border(spark, split_bytes, tmp_path):
    """Record ends that lie across the scan's buffers and across splits are found."""
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    for pad in range(16):
        texts = [record(1, "a" * (65536 - 80 - pad) + "\r\n"), *(record(i, "b" * 900 + "\r\n\r\n") for i in range(2, 40)), record(40, "WARC/1.1 is a payload")]
        (tmp_path / f"{pad}.warc").write_text("".join(texts), newline="")
    for size, files in ((100_000_000, "*"), (14_999, "1.warc")):
        split_bytes(size)
        got = read_archives(spark, f"{tmp_path}/{files}").groupBy("file").count().collect()
        assert [r["count"] for r in got] == [40] * (16 if files == "*" else 1)


def test_foreign_and_torn_archives(spark, tmp_path):
    sha = hashlib.sha1(b"hello").digest()
    import base64

    text = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_text(text + text.replace("uuid:1", "uuid:2").replace("hello", "hullo"), newline="")
    got = {r["record_id"]: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert {k: (r["payload_bytes"], r["verified"], r["page_id"]) for k, r in got.items()} == {"<urn:uuid:1>": (5, True, None), "<urn:uuid:2>": (5, False, None)}
    for bad in (text[:-6], text + "junk", "junk" + text, text + text.replace("Length: 5", "Length: 6")):
        (tmp_path / "a.warc").write_text(bad, newline="")
        with pytest.raises(ValueError, match="the records end at"):
            read_archives(spark, str(tmp_path))


# -- URLs ------------------------------------------------------------------------
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = {
    1: ("http://X.Example.NET/en/a?b#c", "x.example.net", "/en/a", "example.net/en/", "allow"),
    2: ("https://a.net", "a.net", "", None, "allow"),
    3: ("https://a.net/", "a.net", "/", "net/", "block"),
    4: ("https://notnet/x", "notnet", "/x", None, "allow"),
    5: ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    6: ("no scheme", "", "", None, "allow"),
    7: (None, "", "", None, "allow"),
    8: ("http://a?x=://b/", "a", "", None, "allow"),
    9: ("http://plain.example/alias", "plain.example", "/alias", None, "block"),
    10: ("http://plain.example/ok#frag", "plain.example", "/ok", None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "r") for i, u in URLS.items()], "page_id long, url string, rule string")
    edges = [("http://plain.example/alias", "http://hop.example/"), ("http://hop.example/#x", "https://bad.net/z"), ("http://plain.example/ok", "https://bad.net/q"), ("http://plain.example/ok", "http://x.org/fr/"), (None, "http://a"), ("http://a", "http://a")]
    got = {r["page_id"]: tuple(r)[1:] for r in judge(df, RULES, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {i: u[1:] for i, u in URLS.items()}
    assert judge(df.limit(0), RULES, spark.createDataFrame([], "src string, dst string")).count() == 0


def test_many_rules_equal_few(spark, monkeypatch):
    from genoframe.llm import urls

    rng = random.Random(4)
    rules = [(f"h{rng.randrange(9)}.{rng.choice(('com', 'net'))}", f"/{rng.choice('abc')}" * rng.randrange(3), rng.choice(("allow", "block"))) for _ in range(40)] + RULES
    found = [f"http://{rng.choice(('', 'www.', 'a.b.'))}h{rng.randrange(12)}.{rng.choice(('com', 'net', 'org'))}/{rng.choice('abc')}/{rng.choice('abc')}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    host, path = host_and_path(df["url"])
    df = df.select("page_id", host.alias("host"), path.alias("path"))
    few = sorted(map(tuple, fit_rules(df, rules).select("page_id", "rule", "ruled").collect()))
    monkeypatch.setattr(urls, "INLINE_RULES", 2)
    assert sorted(map(tuple, fit_rules(df, rules).select("page_id", "rule", "ruled").collect())) == few


def test_page_edges(spark):
    html = '<LINK href="/c" rel=canonical><link rel="stylesheet" href="s"><meta http-equiv="refresh" content="0; url=\'//other.net/x\'">'
    rows = [("https://h.org/a/b?q", html), ("https://h.org/a/b", "<link rel='canonical' href='d'>"), ("https://h.org", "<link rel=canonical href=http://z.org/>"), (None, html), ("u", None), ("http://q", "<p>")]
    got = {tuple(r) for r in page_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {("https://h.org/a/b?q", "https://h.org/c"), ("https://h.org/a/b?q", "https://other.net/x"), ("https://h.org/a/b", "https://h.org/a/d"), ("https://h.org", "http://z.org/")}


ODD_PAGES = {
    '<link rel="canonical" data-href="http://x.net/" href="/a">': ["/a"],
    '<link rel=canonical title="href=http://x.net/t" href=/b>': ["/b"],
    '<!-- <link rel=canonical href=/no> --><script>"<link rel=canonical href=/no>"</script><style>a>b{}<link rel=canonical href=/no></style><link rel=canonical href=/c>': ["/c"],
    '<title><link rel=canonical href=/no></title><a title="<link rel=canonical href=/no>">x</a><link rel=canonical href=/d>': ["/d"],
    '<link rel=canonical href="/e?x=1&amp;y=2&#38;z=&#x4e2d;&unknown;&#0;&">': ["/e?x=1&y=2&z=中&unknown;&#0;&"],
    '<link rel="alternate Canonical" href="/f">': ["/f"],
    '<link title="a > b" rel="canonical" href="/g">': ["/g"],
    '<link title="a < b" rel="canonical" href="/h">': ["/h"],
    '<link rel=canonical href=/i href=/no><link rel=canonical href=/no>': ["/i"],
    '<link rel=canonical href=""><link\nrel = \'canonical\'\nhref = /j >': ["/j"],
    '<link rel=canonicals href=/no><linkx rel=canonical href=/no><link rel=nocanonical href=/no>': [],
    '<link rel=canonical href=/k <p>': ["/k"],
    "<p don't><link rel=canonical href=/l><p isn't>": ["/l"],
    '<!-- never closed <link rel=canonical href=/no>': [],
    '<script>never closed <link rel=canonical href=/no>': [],
    '<link rel=canonical href="/no>': [],
    '<link rel=canonical xhref=/no data-x=href=/no>': [],
    '<META content="5;URL=/m" HTTP-EQUIV=Refresh>': ["/m"],
    '<meta http-equiv=refresh content="7"><meta http-equiv="refresh" content="0 ; url = &quot;/n&quot; tail">': ["/n"],
    '<meta name=refresh content="0;url=/no"><meta http-equiv=refresh content="0,/o">': ["/o"],
    '<link/rel="canonical"/href="/p">': ["/p"],
    '<link/rel=canonical/href=/no>': [],
}


def test_odd_pages(spark):
    rows = [(f"http://h.org/{i}", page) for i, page in enumerate(ODD_PAGES)]
    got = {}
    for src, dst in page_edges(spark.createDataFrame(rows, "url string, html string")).collect():
        got.setdefault(src, []).append(dst)
    want = {f"http://h.org/{i}": [f"http://h.org{t}" for t in to] for i, to in enumerate(ODD_PAGES.values()) if to}
    assert got == want


def test_targets_are_resolved(spark):
    from genoframe.llm.urls import node_of, resolve

    base = "HTTP://H.org/a/b/c?q#f"
    cases = [
        ("../q", "http://h.org/a/q"), ("./q", "http://h.org/a/b/q"), ("/x/./y/../z", "http://h.org/x/z"), ("../../../q", "http://h.org/q"), ("..", "http://h.org/a/"), (".", "http://h.org/a/b/"),
        ("?z=1/../2", "http://h.org/a/b/c?z=1/../2"), ("#g", "http://h.org/a/b/c?q"), ("//O.net", "http://o.net/"), ("HTTPS://O.net?X=Y", "https://o.net/?X=Y"), ("/..a/.b/c..", "http://h.org/..a/.b/c.."),
        ("mailto:x@y", None), ("", None), ("/q//../r", "http://h.org/q/r"), ("q r\n", "http://h.org/a/b/q r"), ("/" + "x/" * 1500 + "../y", "http://h.org/" + "x/" * 1500 + "../y"),
    ]
    df = spark.createDataFrame([(base, t) for t, _ in cases], "b string, t string")
    assert [r[0] for r in df.select(node_of(resolve(F.col("b"), F.col("t")))).collect()] == [w for _, w in cases]


def test_page_edges_in_one_pass(spark):
    """Tags that never end, many attributes and quotes cost one pass, not one for each."""
    n = 2_000_000
    texts = ["<link " * (n // 6), "<link rel" + " " * n, "<link rel=" + " " * n + "x>", "<meta " + "a='b' " * (n // 6) + ">", "<link rel=canonical href=" + '"' * n + ">", '<link "' * (n // 7), "<link a='" * (n // 9), "<!-- " * (n // 5), "<script> " * (n // 9), "<style></styl" * (n // 13), "<link a=b " * (n // 10), "<link rel=canonical href=" + "../" * (n // 3) + ">", "<link rel=canonical href=" + "&amp;" * (n // 5) + "></link>", "<LINK rel=canonical rel='x' href='/y'>" + "<" * n]
    rows = [("http://h/", t) for t in texts]
    began = time.perf_counter()
    got = [r["dst"] for r in page_edges(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == sorted(["http://h/" + "../" * (n // 3), "http://h/" + "&" * (n // 5), "http://h/y"])
    assert time.perf_counter() - began < 30


# -- vectors ---------------------------------------------------------------------
def test_embeddings(spark, monkeypatch):
    from genoframe.llm import embeddings

    monkeypatch.setattr(embeddings, "PART", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(240):
        v = centres[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.5])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(300 + k, rows[7][1], rows[7][2]) for k in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, rows[7][1], None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [float("inf")] * 16, 0)]
    # squares that run over or out, and a component beside which another one vanishes
    rows += [(410, [1e200, 0.0], 3), (411, [2e200, 1e180], 3), (412, [3e-200, 0.0], 3), (413, [0.0, 5e-324], 3), (414, [1e-300, 4e-310], 3), (415, [0.0, -1e308], 3)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, kept int").repartition(3)
    good = [(i, np.array(v, dtype=float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = [(i, x / np.abs(x).max(), y) for i, x, y in good]
    links = {(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93}
    assert {(410, 411), (410, 412), (411, 414)} <= links
    got = {r["vec_id"]: r for r in near_duplicates(df).collect()}
    assert {i: got[i]["component_id"] for i, _, _ in rows} == union([r[0] for r in rows], links)
    n = {i: sum(i in x for x in links) for i, _, _ in rows}
    assert {i: got[i]["n_links"] for i in n} == n and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert near_duplicates(df.limit(0)).count() == 0
    assert plan_tables(10)[0] == 4 and plan_tables(10**8)[0] > 16


# -- chat ------------------------------------------------------------------------
TOOLS = {
    "f": {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}, "required": ["a"]},
    "g.h": {"properties": {"a.b": {"type": ["integer", "null"]}, "it's \"x\"?": {}, "n": {"type": "number"}}, "required": ["a.b"]},
}
CALLS = "conv long, seq long, id string, name string, arguments string, depends array<string>"
RESULTS = "conv long, seq long, id string, content string"


def test_calls(spark):
    calls = [
        (1, 0, "x", "f", '{"b": "t", "a": 1}', ["z"]), (1, 1, "y", "f", '{"a": "no", "c": {"q": 1, "p": [2, 1]}}', []), (1, 2, "z", "g", "{}", ["y"]),
        (2, 0, "p", "f", '{"a": 2}', ["q"]), (2, 1, "q", "f", None, ["p"]), (2, 2, "r", "f", "[1]", ["nope"]), (2, 3, "s", "f", '{"a": 1}', ["p"]),
        (3, 0, None, "f", '{"a": 3}', None), (3, 1, "d", "f", '{"a": 4}', []), (3, 1, "d", "f", '{"a": 4}', []),
    ]
    results = [(1, 3, "x", "ok"), (1, 4, "y", None), (1, 5, "y", "late"), (2, 9, "lost", "?"), (3, 3, None, "none")]
    df = spark.createDataFrame([(*c, 1) for c in calls], CALLS + ", level int")
    out = link_calls(df, spark.createDataFrame(results, RESULTS), TOOLS).collect()
    by = {(r["conv"], r["id"]): r for r in out}
    assert len(out) == len(calls) + 1
    assert [i for _, i in sorted((r["position"], r["id"]) for r in out if r["conv"] == 1)] == ["y", "z", "x"]
    assert {k[1]: (r["status"], r["valid"], r["errors"]) for k, r in by.items() if k[1]} == {
        "x": ("linked", True, []), "y": ("repeated_result", False, ["type:a", "unknown:c"]), "z": ("missing_result", False, ["unknown_tool"]),
        "p": ("missing_result", False, ["cycle"]), "q": ("missing_result", False, ["not_an_object", "cycle"]), "r": ("missing_result", False, ["not_an_object", "unresolved:nope"]),
        "s": ("missing_result", False, ["cycle"]), "d": ("missing_result", True, []), "lost": ("orphan_result", False, ["no_call"]),
    }
    assert by[1, "x"]["canonical"] == '{"arguments":{"a":1,"b":"t"},"depends_on":["z"],"id":"x","name":"f","result":"ok","status":"linked"}'
    assert json.loads(by[1, "y"]["canonical"])["arguments"] == {"a": "no", "c": {"p": [2, 1], "q": 1}}
    assert sorted(r["position"] for r in out if r["conv"] == 3) == [0, 1, 2]
    assert link_calls(df.limit(0), spark.createDataFrame([], RESULTS), TOOLS).count() == 0


def test_identifiers_count_within_a_conversation(spark):
    calls = [(c, 0, "call_0", "f", f'{{"a": {c}}}', ["call_1"]) for c in (1, 2)] + [(1, 1, "call_1", "f", '{"a": 1}', []), (None, 0, "call_0", "f", '{"a": 9}', [])]
    results = [(1, 2, "call_0", "one"), (2, 2, "call_0", "two"), (None, 1, "call_0", "none"), (3, 0, "call_0", "lone")]
    out = {(r["conv"], r["id"]): r for r in link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()}
    assert {k: (r["status"], r["position"], r["errors"], json.loads(r["canonical"])["result"]) for k, r in out.items()} == {
        (1, "call_0"): ("linked", 1, [], "one"), (1, "call_1"): ("missing_result", 0, [], None), (2, "call_0"): ("linked", 0, ["unresolved:call_1"], "two"),
        (None, "call_0"): ("linked", 0, [], "none"), (3, "call_0"): ("orphan_result", 0, ["no_call"], "lone"),
    }


def test_arguments_fit_schemas(spark):
    cases = {
        '{"a.b": 1}': [], '{"a.b": 1.0}': [], '{"a.b": null}': [], '{"a.b": 1e3}': [], '{"a.b": 1.5}': ["type:a.b"], '{"a.b": "1"}': ["type:a.b"], "{}": ["missing:a.b"],
        '{"a.b": 1, "it\'s \\"x\\"?": {"deep": []}}': [], '{"a.b": 1, "a": {"b": 2}}': ["unknown:a"], '{"a.b": 1, "n": 2.5}': [], '{"a.b": 1, "n": true}': ["type:n"], '{"a.b": 1, "a.b": 2}': ["not_an_object"],
    }
    calls = [(i, 0, "c", "g.h", text, None) for i, text in enumerate(cases)]
    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect()
    assert {r["conv"]: r["errors"] for r in got} == dict(enumerate(cases.values()))
    with pytest.raises(ValueError, match="no JSON type"):
        link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {"properties": {"a": {"type": "int"}}}})


def test_arguments_fit_nested_schemas(spark):
    point = {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": 10}, "tag": {"enum": ["a", 1, None, {"k": [1]}]}}, "required": ["x"]}
    schema = {
        "type": "object", "description": "a tool",
        "properties": {
            "o": point, "free": {"type": "object"}, "e": {"enum": ["u", "v"], "title": "one of"}, "list": {"type": "array", "items": point, "minItems": 1, "maxItems": 2}, "s": {"type": "string", "minLength": 2, "maxLength": 3},
            "deep": {"items": {"items": {"type": "integer"}}}, "open": {"properties": {"a": {"const": 7}}, "additionalProperties": True}, "any": True,
        },
    }
    cases = {
        '{"o":{"x":1,"tag":"a"},"e":"u"}': [], '{"o":{"y":"no"},"e":"zzz"}': ["missing:o/x", "enum:e", "unknown:o/y"], '{"o":{"x":"1"}}': ["type:o/x"], '{"o":{"x":11}}': ["range:o/x"], '{"o":{"x":-0.5}}': ["range:o/x"],
        '{"o":{"x":1,"tag":1.0}}': [], '{"o":{"x":1,"tag":null}}': [], '{"o":{"x":1,"tag":{"k":[1]}}}': [], '{"o":{"x":1,"tag":{"k":[2]}}}': ["enum:o/tag"], '{"o":{"x":1,"tag":"1"}}': ["enum:o/tag"], '{"o":[]}': ["type:o"],
        '{"free":{"q":{"r":1}}}': [], '{"list":[]}': ["length:list"], '{"list":[{"x":1},{"x":true},{"z":1}]}': ["missing:list[2]/x", "type:list[1]/x", "length:list", "unknown:list[2]/z"], '{"list":{"x":1}}': ["type:list"],
        '{"s":"é"}': ["length:s"], '{"s":"éé"}': [], '{"s":"long"}': ["length:s"], '{"deep":[[1,2],[3,"x"],"no list"]}': ["type:deep[1][1]"], '{"open":{"a":7,"more":1}}': [], '{"open":{"a":8}}': ["enum:open/a"], '{"any":[{}]}': [], "{}": [],
    }
    calls = [(i, 0, "c", "t", text, None) for i, text in enumerate(cases)]
    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"t": schema}).collect()
    assert {r["conv"]: r["errors"] for r in got} == dict(enumerate(cases.values()))
    for bad, why in (({"properties": {"a": {"properties": {"b": {"pattern": "x"}}}}}, "t.a.b: keywords"), ({"additionalProperties": {}}, "true or false"), ({"items": {"type": "int"}}, "t.items: no JSON type"), ({"properties": {"a": 3}}, "must be an object")):
        with pytest.raises(ValueError, match=why):
            link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"t": bad})


def test_unparsable_arguments_are_kept(spark):
    calls = [(1, i, f"c{i}", "f", text, None) for i, text in enumerate(['{"a":1,"a":2}', "not json", None, '{"a": 1}'])]
    got = {r["id"]: r for r in link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect()}
    assert [json.loads(got[f"c{i}"]["canonical"])["arguments"] for i in range(4)] == ['{"a":1,"a":2}', "not json", None, {"a": 1}]
    assert [got[f"c{i}"]["valid"] for i in range(4)] == [False, False, False, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_topological(spark, seed):
    """A chain of 500 that stands in the wrong order, and random graphs."""
    rng = random.Random(seed)
    calls = [(1, i, f"c{i}", "f", '{"a": 1}', [f"c{i + 1}"] if i < 499 else []) for i in range(500)] if seed == 1 else []
    for conv in range(2, 12):
        ids = [f"c{i}" for i in range(15)]
        rank = rng.sample(ids, 15)
        calls += [(conv, i, c, "f", '{"a": 1}', rng.sample(rank[: rank.index(c)], min(rank.index(c), rng.randrange(4)))) for i, c in enumerate(ids)]
    rng.shuffle(calls)
    got = link_calls(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame([], RESULTS), TOOLS).collect()
    at = {(r["conv"], r["id"]): r["position"] for r in got}
    assert all(at[c, d] < at[c, i] for c, _, i, _, _, deps in calls for d in deps) and all(r["valid"] for r in got)
    assert all(sorted(p for (c, _), p in at.items() if c == conv) == list(range(n)) for conv, n in [(2, 15), *([(1, 500)] if seed == 1 else [])])


def test_turns(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 0, "assistant", "?"), (3, 0, "system", "alone")], "conv_id long, turn long, role string, text string")
    got = {r["id"]: (r["position"], r["status"], r["valid"]) for r in link_calls(*turns_as_calls(m), {"ask": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"]}, "configure": {"properties": {"text": {"type": "string"}}}}).collect()}
    assert got == {"1:0": (2, "missing_result", True), "1:1": (0, "linked", True), "1:3": (1, "missing_result", False), "2:-1": (0, "orphan_result", False), "3:0": (0, "missing_result", False)}


# -- pipeline --------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_texts import shingle_set, words

    rng = random.Random(6)
    syllables = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["ung", "sch", "ei", "och", "ich"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(2, 5))) for _ in range(n))
    plain = [(i, text("aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb") for i in range(300)]
    toxic = [(1000 + i, text("aa", 30) + " grumblesnort " + text("aa", 30), "aa") for i in range(80)]
    item = " ".join(words(rng, 30))
    leaks = [(2000 + i, text("aa", 30) + " " + item + " " + text("aa", 20), "aa") for i in range(5)]
    near = [(3000 + i, plain[3][1] + " " + "more " * (i % 3), "aa") for i in range(6)]
    odd = [(4000, None, "aa"), (4001, "", "aa"), (4002, "12 34", "bb")]
    rows = plain + toxic + leaks + near + odd
    spark.createDataFrame([(*r, "src", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in plain] + [(i, 1, 1) for i, _, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in plain}
    assert len(shingle_set(plain[3][1])) > 50 and all(n > 0 for n in got.values())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_columns_and_repeated_ids(spark):
    """Columns of any name pass through all stages; of rows of one id, texts that differ stay."""
    import corpus_pipeline
    from tests.llm.test_texts import words

    rng = random.Random(12)
    long, short, other = (" ".join(words(rng, n)) for n in (60, 40, 50))
    rows = [(1, long, "b"), (1, long, "a"), (1, short, "c"), (2, long + " end", "d"), (3, other, "e"), (3, other, "e"), (None, other, "f"), (4, None, "g"), (4, None, "h"), (5, "", "i")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _gone int, _again int, component_id long, `it``s` map<string,int>, n_tokens string, IDS int"
    docs = spark.createDataFrame([(i, t, "x", None, 1, mark, 1, 2, 3, {"k": 1}, "clash", 7) for i, t, mark in rows], schema)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["a.b"]) for r in kept.collect() if r["doc_id"]) == sorted([(1, long, "a"), (1, short, "c"), (3, other, "e"), (4, None, "g"), (5, "", "i")], key=lambda r: (r[0], r[1] or ""))
    assert [r["a.b"] for r in kept.collect() if r["doc_id"] is None] == ["f"]
    coded = corpus_pipeline.encode(spark, docs, "")
    assert coded.columns == [*docs.columns[:-2], "n_tokens", "ids", "decoded_sha256"]
    got = {(r["doc_id"], r["a.b"]): r for r in coded.collect()}
    assert got[4, "g"]["ids"] == [] and got[4, "g"]["n_tokens"] == 0 and got[3, "e"]["n_tokens"] == len(got[3, "e"]["ids"]) > 10 and len(got) == 9
    assert corpus_pipeline.encode(spark, docs.limit(0), "").columns == coded.columns and corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0


def test_pipeline_drops_what_stages_wrote(spark, tmp_path):
    import corpus_pipeline
    from genoframe.llm import scratch

    docs = [(i, f"plain text number {i} of a few words", "aa", "s", 1) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(scratch._made)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(scratch._made) - before
    assert len(left) == 1 and out.count() == 30
    scratch.clear(spark)
    assert not scratch._made
