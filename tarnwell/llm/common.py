"""What the operators of this package share: white space, scratch tables, batches of rows.

White space is exactly space and U+0009 to U+000D, and a word is a longest run of
anything else. ``bytes.split()`` splits on the same six characters, so Python code
splits the UTF-8 form and never ``str.split()``, which knows more kinds of space.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.stores import store

#: Java and RE2 regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Prefix of working columns, so that a caller's columns of any usual name survive.
OWN = "__tw_"


def own(name: str) -> str:
    return OWN + name


def whole_text(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def collapsed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _local_scratch(spark)


def _local_scratch(spark: SparkSession) -> str:
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnwell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/tarnwell/{what}-{uuid.uuid4().hex}"


#: Folders of tables written since the innermost temporary() began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that materialise writes inside are removed at the end, but for kept ones; nothing lazy may need them then."""
    folders: list[str] = []
    before = _WRITTEN.set(folders)
    try:
        yield
    finally:
        _WRITTEN.reset(before)
        for folder in folders:
            fs, path = store(folder)
            fs.delete_dir(path)


def materialise(df: DataFrame, what: str, codec: str = "snappy", keep: bool = False) -> DataFrame:
    """Write a (narrow) table to the shared folder and read it again.

    This cuts lineage, is computed once however often it is read, survives lost
    executors, and gives later joins the table's measured size.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", codec).parquet(path)
    if not keep and (folders := _WRITTEN.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives Arrow's unused memory back when a task ends, as idle workers are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return run


#: Bytes of an Arrow batch, and Spark's setting of them.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python in Arrow batches of about BATCH_BYTES, unless it has a bound of its own.

    By rows alone a batch of texts has tens of MB, which the executor and its worker hold at once.
    The setting stays, as plans read it when they run.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def split(text: str) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode("utf-8", "replace").split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
