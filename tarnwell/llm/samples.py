"""Bounded samples of labelled texts, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own, whole_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label, key) of at most per_class documents of each class, chosen by hash of id; and how many labelled ids each class has.

    A class's share of labels says how to weigh its sampled rows. ``allowed`` limits
    the ids. Ids with null labels are left out; an id labelled twice has its largest
    label, and one with several texts its least; so the rows are at most per_class
    times the number of classes.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    ids = ids.where(allowed) if allowed is not None else ids
    ids = ids.groupBy(F.col(id_col).alias(own("id"))).agg(F.max(label).cast("int").alias(own("label")))
    counts = {k: n for k, n in ids.groupBy(own("label")).count().collect()}
    spark = docs.sparkSession
    chosen = [row for k in sorted(counts) for row in ids.where(F.col(own("label")) == k).orderBy(F.xxhash64(own("id")), own("id")).limit(per_class).collect()]
    few = spark.createDataFrame(chosen, ids.schema)
    rows = docs.join(F.broadcast(few), docs[id_col] == few[own("id")])
    one = rows.groupBy(few[own("id")], few[own("label")]).agg(F.min(whole_text(text_col)).alias("text"))
    return one.select("text", F.col(own("label")).alias("label"), F.xxhash64(own("id")).alias("key")), counts
