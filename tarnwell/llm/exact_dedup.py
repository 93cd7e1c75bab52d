"""Exact dedup (operator 9) by skew-safe combining.

1. Locally: each map task's partial aggregate keeps one row per (digest, salt, text),
   so a group of copies leaves a task as a few rows however many it has there.
2. Salted: these meet by (digest, salt, text); a digest's rows are spread over SALTS.
3. Globally: the salt winners meet by (digest, text).

Each stage groups by the full normalised text beside the digest, so it is compared
in full. Winners go back to the rows by digest alone; a digest that stands for two
texts (none is known) is found in the winners and its rows are joined by full text.

Defined results: a null text counts as empty and all empty texts are equal; a null
doc_id never wins over another one and a group with only null ids keeps one of them;
of repeated rows (same doc_id, equal text) one is kept, the first by its other
columns; texts of any length are compared whole, within a row's limit of 2 GB; an empty
table gives an empty result; further columns are carried by
``deduplicated`` and ignored by ``exact_groups``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import collapsed, materialise, own, read, whole_text

#: Parts of a hot digest group in the second stage.
SALTS = 16
DIGEST, TEXT, SALT, ID = own("digest"), own("norm"), own("salt"), own("id")
KEEP, SIZE, RANK = own("keep"), own("size"), own("rank")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(rows: DataFrame) -> DataFrame:
    """rows: ID and TEXT. One row (DIGEST, TEXT, KEEP, SIZE) for each text."""
    salt = F.pmod(F.xxhash64(ID), F.lit(SALTS))
    local = rows.select(ID, TEXT, _digest(F.col(TEXT)).alias(DIGEST), salt.alias(SALT))
    salted = local.groupBy(DIGEST, SALT, TEXT).agg(F.min(ID).alias(KEEP), F.count(F.lit(1)).alias(SIZE))
    return salted.groupBy(DIGEST, TEXT).agg(F.min(KEEP).alias(KEEP), F.sum(SIZE).alias(SIZE))


def _matched(rows: DataFrame, text: Column, id_col: str) -> DataFrame:
    """rows with DIGEST, KEEP and SIZE; each text is read once more, none is moved unless two texts share a digest."""
    winners = _winners(rows.select(F.col(id_col).alias(ID), text.alias(TEXT)))
    digests = materialise(winners.select(DIGEST, KEEP, SIZE), "exact")
    rows = rows.withColumn(DIGEST, _digest(text))
    clashing = digests.groupBy(DIGEST).agg(F.count(F.lit(1)).alias(RANK)).where(F.col(RANK) > 1).select(DIGEST)
    if clashing.isEmpty():
        return rows.join(digests, DIGEST)
    plain = rows.join(clashing, DIGEST, "left_anti").join(digests, DIGEST)
    exact = rows.withColumn(TEXT, text).join(clashing, DIGEST, "left_semi").join(winners, [DIGEST, TEXT]).drop(TEXT)
    return plain.unionByName(exact.select(plain.columns))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256."""
    text = collapsed(whole_text(text_col))
    narrow = _matched(docs.select(F.col(id_col).alias(ID), F.col(text_col).alias(own("raw"))), collapsed(whole_text(own("raw"))), ID)
    narrow = narrow.drop(own("raw"))
    # Only rows that tie for a group's smallest id are ranked, so a hot group is not one task's window.
    first = F.col(ID).eqNullSafe(F.col(KEEP))
    winner = narrow.where(first).withColumn(RANK, F.row_number().over(Window.partitionBy(DIGEST, ID).orderBy(F.lit(1))) == 1)
    rest = narrow.where(~first).withColumn(RANK, F.lit(False))
    return winner.unionByName(rest).select(F.col(ID).alias(id_col), F.col(KEEP).alias("keep_id"), F.col(SIZE).alias("group_size"), F.col(RANK).alias("kept"), F.col(DIGEST).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    rows = _matched(docs, collapsed(whole_text(text_col)), id_col)
    winner = rows.where(F.col(id_col).eqNullSafe(F.col(KEEP)))
    order = [F.col(c).cast("string").asc_nulls_last() for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")] or [F.lit(1)]
    ranked = winner.withColumn(RANK, F.row_number().over(Window.partitionBy(DIGEST, id_col).orderBy(*order)))
    return ranked.where(F.col(RANK) == 1).select(docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
}
