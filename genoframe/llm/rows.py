"""Rows kept as they are by what is decided on their text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are decided on together.
TOGETHER = 1000


def keep_rows(docs: DataFrame, text: str, decider: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, that are decided to be kept. ``decider`` runs
    once in each task and gives the function from texts to decisions."""
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                yield piece.filter(pa.array(decide(piece.column(at_text).to_pylist()), pa.bool_()))

    plain = by_place(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def by_place(docs: DataFrame) -> DataFrame:
    """The columns named by their places, since not every name can stand in an expression."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
