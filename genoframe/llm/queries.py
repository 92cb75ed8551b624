"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import language, toxicity
from genoframe.llm.bpe import bpe_encode
from genoframe.llm.chat import link_calls, turns_as_calls
from genoframe.llm.decontaminate import find_passages
from genoframe.llm.embeddings import near_duplicates
from genoframe.llm.fim import fill_in_middle, restored
from genoframe.llm.jaccard import jaccard_components
from genoframe.llm.merkle import folded, leaf_digest, manifest, proof
from genoframe.llm.scratch import new_path
from genoframe.llm.sharding import SEED, SHARDS, assign_shards
from genoframe.llm.tokens import read_tokens, with_crc32, write_tokens
from genoframe.llm.urls import judge, page_edges
from genoframe.llm.warc import read_archives, write_archives

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int):
    """The remainder of a key's checksum, by which rows are held out."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % parts


#: The tools that conversations' turns are taken for.
TOOLS = {
    "ask": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"]},
    "configure": {"properties": {"text": {"type": "string"}}, "required": ["text"]},
}


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that asks or configures, linked with its answer, in order."""
    linked = link_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "position", F.col("name").alias("tool"), "status", "valid", "canonical")


#: For conversations whose turns are not repeated and whose system turns stand apart.
OP1_SQL = """
WITH calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS id, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS tool, text,
         CASE WHEN role = 'system' THEN turn + 1 WHEN turn >= 2 THEN turn - 2 END AS waits_for
  FROM conversations WHERE role IN ('user', 'system')
), linked AS (
  SELECT c.*, r.text AS result, r.conv_id IS NOT NULL AS answered, c.waits_for IS NOT NULL AND d.conv_id IS NULL AS lost
  FROM calls c LEFT JOIN (SELECT * FROM conversations WHERE role NOT IN ('user', 'system')) r ON c.conv_id = r.conv_id AND c.turn + 1 = r.turn
  LEFT JOIN calls d ON c.conv_id = d.conv_id AND c.waits_for = d.turn
), orphans AS (
  SELECT r.conv_id, r.turn, r.conv_id || ':' || (r.turn - 1) AS id, r.text FROM conversations r
  LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn + 1 = r.turn WHERE r.role NOT IN ('user', 'system') AND c.conv_id IS NULL
), rows AS (
  SELECT conv_id, id, CASE WHEN tool = 'configure' AND NOT lost THEN 1 ELSE 0 END AS late, turn, tool, CASE WHEN answered THEN 'linked' ELSE 'missing_result' END AS status, text IS NOT NULL AND NOT lost AS valid,
         CASE WHEN tool = 'ask' THEN '{"text":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{"text":' || to_json(text) || '}' END AS arguments,
         CASE WHEN waits_for IS NOT NULL THEN '["' || conv_id || ':' || waits_for || '"]' ELSE '[]' END AS depends, result FROM linked
  UNION ALL SELECT conv_id, id, 2, turn, NULL, 'orphan_result', false, 'null', '[]', text FROM orphans
)
SELECT conv_id, id AS call_id, row_number() OVER (PARTITION BY conv_id ORDER BY late, turn, id) - 1 AS position, tool, status, valid,
       '{"arguments":' || arguments || ',"depends_on":' || depends || ',"id":"' || id || '","name":' || coalesce('"' || tool || '"', 'null')
         || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS canonical
FROM rows
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives it was written to."""
    records = read_archives(spark, write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "verified")


OP2_SQL = """
WITH sums AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
equal AS (SELECT sha1(body) AS digest, max(page_id) AS first FROM sums GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN strlen(body) >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 1000 AND page_id <> first THEN first END AS refers_to,
       CASE WHEN strlen(body) >= 1000 AND page_id <> first THEN NULL ELSE true END AS verified
FROM sums JOIN equal ON sha1(body) = digest
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Host, path and verdict of the rules that pages are judged by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, page_edges(pages))


#: Without redirects or canonical links in the table, a page without a rule is allowed.
OP4_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM urls, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON u.page_id = f.page_id
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label that nearly point the same way."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def learned_languages(docs: DataFrame) -> language.Learned:
    return language.Learned(docs.where(fold("doc_id", 4) != 2))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, learned_languages(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold passages of."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards of one mixture, by row counts."""
    placed = assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))"


def _crc_sql(numbers: str) -> str:
    """The checksum of a list of bytes, by the table ``t``."""
    return f"xor(list_reduce([4294967295] || {numbers}, lambda c, o: xor(c // 256, t[xor(c, o) % 256 + 1])), 4294967295)"


OP8_SQL = f"""
WITH crc AS ({_CRC_TABLE}), hashed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, source, {_crc_sql("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS text_crc32,
         sha256('{SEED}|' || coalesce('=' || doc_id, '-') || '|' || coalesce('=' || sha256(text), '-') || '|' || coalesce('=' || source, '-')) AS h FROM documents, crc
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction, count(*) OVER () AS total FROM hashed
), placed AS (SELECT *, row_number() OVER (ORDER BY fraction, h) - 1 AS pos FROM ranked),
dealt AS (SELECT *, pos * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are alike, by components of exact links."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def learned_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Field:
    """A field fitted to the labels of four folds of five."""
    return toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its offending spans by character offset."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, learned_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its form for filling in the middle, and made whole again from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM drawn
), cut AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the files they were written to."""
    path = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path())
    return with_crc32(read_tokens(spark, path))


#: The fields of a leaf, in order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether it still leads to the root after one in
    seven was tampered with."""
    docs = table(spark, sf_dir, "documents")
    forged = leaf_digest(*(F.col(f) if f != "n_chars" else F.col(f).cast("decimal(20,0)") + 1 for f in LEAF_FIELDS))
    found = manifest(docs, LEAF_FIELDS, also={"forged": F.when(fold("doc_id", 7) == 0, forged)})
    found = found.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Checksums by their table of 256, nodes by level with their siblings, then each leaf's fold.
OP13_SQL = """
WITH RECURSIVE crc AS ({table}), docs AS (
  SELECT d.*, {crc} % 7 = 0 AS forged
  FROM documents d, crc
), texts AS (
  SELECT doc_id, lang, {fields} AS own, {altered} AS other, forged FROM docs
), leaves AS (
  SELECT doc_id, lang, sha256(own) AS leaf, sha256(CASE WHEN forged THEN other ELSE own END) AS given, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM texts
), low AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, level, i // 2, (n + 1) // 2
), high AS (
  SELECT 0 AS level, g AS i, (SELECT max(g) + 1 FROM leaves) AS n, h FROM low WHERE n = 1
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, (n + 1) // 2
), steps AS (
  SELECT l.doc_id, own.level AS step, own.i % 2 AS side, coalesce(sib.h, '') AS sib FROM leaves l
  JOIN low own ON own.g = l.g AND own.n > 1 AND own.i = l.i // (1 << own.level) LEFT JOIN low sib ON sib.g = own.g AND sib.level = own.level AND sib.i = xor(own.i, 1)
  UNION ALL
  SELECT l.doc_id, 64 + own.level, own.i % 2, coalesce(sib.h, '') FROM leaves l
  JOIN high own ON own.n > 1 AND own.i = l.g // (1 << own.level) LEFT JOIN high sib ON sib.level = own.level AND sib.i = xor(own.i, 1)
), paths AS (SELECT doc_id, list(struct_pack(side := side, sib := sib) ORDER BY step) AS path, string_agg(sib, '' ORDER BY step) AS siblings FROM steps GROUP BY doc_id),
fold AS (
  SELECT l.doc_id, l.given AS h, 0 AS done, coalesce(p.path, []) AS path FROM leaves l LEFT JOIN paths p ON p.doc_id = l.doc_id
  UNION ALL SELECT doc_id, sha256(CASE WHEN path[done + 1].side = 0 THEN h || path[done + 1].sib ELSE path[done + 1].sib || h END), done + 1, path FROM fold WHERE done < len(path)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN fold f ON f.doc_id = l.doc_id AND f.done = len(f.path) JOIN low s ON s.g = l.g AND s.n = 1 JOIN high r ON r.n = 1 LEFT JOIN paths p ON p.doc_id = l.doc_id
""".format(
    table=_CRC_TABLE, crc=_crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"),
    **{name: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) for name, columns in (("fields", LEAF_FIELDS), ("altered", [f if f != "n_chars" else "n_chars + 1" for f in LEAF_FIELDS]))}
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_urls": op4_urls,
    "op5_language": op5_language,
    "op6_embeddings": op6_embeddings,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_jaccard": op9_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_fim": op11_fim,
    "op12_tokens": op12_tokens,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_urls": OP4_SQL,
    "op8_shards": OP8_SQL,
    "op11_fim": OP11_SQL,
    "op13_merkle": OP13_SQL,
}
