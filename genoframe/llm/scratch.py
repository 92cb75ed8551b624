"""Tables that cut lineage, kept in the folder that driver and executors share.

A table goes once nothing reads it any more: operators drop their own intermediate
tables, ``collected`` drops what was made within it, and ``clear`` drops the rest,
which are the tables that results still read, when a program is done with its results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths of tables that were not dropped yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder if
    driver and executors are one process, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="genoframe-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def collected(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Drop, at the end, the tables made within; those in ``keep`` by then stay."""
    before = set(_made)
    yield
    for path in [p for p in _made if p not in before and p not in keep]:
        remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Drop all tables; results that read them can't be used any more."""
    for path in list(_made):
        remove(spark, path)


class Scratch:
    """Written tables, to be dropped once a later table no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and read it back."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._genoframe_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Drop tables; frames that were not written are passed over."""
        for t in tables:
            if getattr(t, "_genoframe_path", None):
                remove(self.spark, t._genoframe_path)
                t._genoframe_path = None
