"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnwell.sources.stores import store


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of this machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnwell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Saved:
    """The tables of one computation: written by calling, and removed at the end of the with block, but for kept ones.

    A table cuts lineage, survives lost executors, and gives later joins its measured size.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def __enter__(self) -> Saved:
        return self

    def __exit__(self, *raised: object) -> None:
        for folder in self.folders:
            fs, path = store(folder)
            fs.delete_dir(path)

    def __call__(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tarnwell/saved-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            self.folders.append(path)
        return self.spark.read.schema(df.schema).parquet(path)
