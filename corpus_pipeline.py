"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. ``toxicity`` drops documents that the random field scores as toxic.
2. ``language`` drops documents whose language stays open.
3. ``near_duplicates`` keeps one document of each group of similar ones.
4. ``decontamination`` drops documents that hold a passage of the benchmark.
5. ``tokens`` adds the ids of what is left.

Each stage's result is written and read again; what a stage wrote on its way, and the
result before, go once its own result is written.

Defined results, in every stage: all columns are carried through, whatever their names
and types, but that ``tokens`` puts its own in the place of input columns named as they
are. An empty table gives one. A null, empty or letterless text is not toxic, has no
language and so goes in the second stage; given to a later stage it links with nothing,
holds no passage and has no ids. Rows without an id are judged by their text like any
other but belong to no group. Rows that repeat an id stay together if their texts differ;
of those that repeat id and text, the first by its JSON stays. A document's group keeps the
smallest id, ties being rows of one id. Texts are used whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import language, toxicity
from genoframe.llm.bpe import with_tokens
from genoframe.llm.decontaminate import clean_documents
from genoframe.llm.jaccard import jaccard_components
from genoframe.llm.queries import learned_languages, learned_toxicity, table, tokenizer_path
from genoframe.llm.scratch import Scratch, collected

#: Ids up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _all(docs: DataFrame) -> list[Column]:
    """Every column, whatever stands in its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, learned_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unknown(docs, learned_languages(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the smallest id."""
    scratch = Scratch(spark)
    groups = scratch.table(jaccard_components(docs), "groups")
    gone = scratch.table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.join(_small(gone), docs["doc_id"] == gone["_gone"], "left_anti").select(_all(docs))
    repeated = groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again")
    repeated = scratch.table(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    again = _small(repeated)
    is_one = kept["doc_id"] == repeated["_again"]
    once = kept.join(again, is_one, "left_anti")
    row = F.struct(*_all(docs))
    # a digest stands for the text in the key
    of = ["doc_id", F.sha2(F.col("text").cast("string"), 256), F.col("text").isNull()]
    first = kept.join(again, is_one, "left_semi").groupBy(*of).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.unionAll(first.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with ``n_tokens``, ``ids`` and ``decoded_sha256``."""
    return with_tokens(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]

#: Compression, the field's fit and BPE are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        keep: list[str] = []
        with collected(spark, keep):
            done = scratch.table(stage(spark, docs, sf_dir), name)
            keep.append(done._genoframe_path)
        scratch.drop(docs)
        docs = done
    return docs
