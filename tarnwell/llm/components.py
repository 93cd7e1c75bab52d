"""Connected components of links between 16-byte ids, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b. One row (id, label) per linked id; a label is its component's smallest id.

    Each round takes the smallest label among neighbours and then the label of that
    label, so the rounds needed grow with the logarithm of a component's width. Every
    round is written to the shared folder; nothing is collected but a count.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("to"))
        jumped = lower.join(labels.select(F.col("id").alias("to"), F.col("label").alias("beyond")), "to", "left")
        following = materialise(jumped.select("id", F.least("to", F.coalesce("beyond", "to")).alias("label"), (F.least("to", F.coalesce("beyond", "to")) != F.col("old")).alias("moved")), "labels")
        labels = following.select("id", "label")
        if following.where("moved").isEmpty():
            return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of components(), or None, with further links: these join components, not ids, so only they are walked."""
    if labels is None:
        return components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    of = lambda end: known.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    to = components(between).select(F.col("id").alias("label"), F.col("label").alias("to"))
    return materialise(known.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
