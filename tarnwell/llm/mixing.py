"""Mixing sources to target weights (operator 5) by capped water-filling, native.

A source's target is min(cap_s, level * weight_s), cap_s being max_epochs times its
size; ``level`` is where the targets add up to the wanted total. Sources ordered by
cap_s / weight_s fill up in that order, so running sums over one row per source give
the level in closed form: what the capped sources cannot take is shared among the
others by weight until none is above its cap.

target / size is a source's number of repetitions: the whole part repeats each
document, the fraction f takes a seeded share of them once more. Documents have a
seeded order (md5 of seed, id and text digest); those before the point where the
running sum of sizes reaches f * size are taken. The point is found in two levels,
so no source is sorted by one task: sums over BUCKETS ranges of the order first,
then rows of the one range that the point lies in.

Defined results: a null text has size 0; null is a source of its own, ordered last;
a null id takes part; rows that agree in id and text share a place in the order and
are taken together; an empty table gives an empty result; when all sizes are 0, so
are targets; texts of any length are counted and digested whole, and move only with their
own row in ``mixed``, which carries further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, own, read, whole_text

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "tarnwell-mix-1"
#: Ranges of the order: the first three hexadecimal digits of a key.
BUCKETS = 4096
SRC, SIZE, KEY, BUCKET, ID = own("src"), own("size"), own("key"), own("bucket"), own("id")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(whole_text(text_col))))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias(ID), F.col(source_col).cast("string").alias(SRC), n_words(whole_text(text_col)).alias(SIZE), order_key(id_col, text_col, seed).alias(KEY))


def water_filled(totals: DataFrame, share: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """totals: SRC and SIZE, one row per source. With target, whole and wanted, the words of the fractional repetition."""
    by_name = Window.orderBy(F.col(SRC).isNull(), SRC)
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col(SIZE)).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col(SRC).isNull(), SRC)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum(SIZE).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_weight)
    # The first source, in filling order, that the level does not fill up sets the level of all.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"]
    t = t.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))))
    whole = F.when(F.col(SIZE) > 0, F.floor(F.col("target") / F.col(SIZE))).otherwise(F.lit(0)).cast("long")
    return t.withColumn("whole", whole).select(SRC, F.col(SIZE).alias("source_size"), "target", "whole", (F.col("target") - whole * F.col(SIZE)).alias("wanted"))


def repetitions(narrow: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """narrow: of sized(), written. One row per source: target, whole, and the last (bucket, key) of the fractional repetition."""
    narrow = narrow.withColumn(BUCKET, F.substring(KEY, 1, 3))
    buckets = narrow.groupBy(SRC, BUCKET).agg(F.sum(SIZE).alias("sum"))
    totals = water_filled(buckets.groupBy(SRC).agg(F.sum("sum").alias(SIZE)), share, max_epochs, weights)
    totals = materialise(totals, "sources")
    running = Window.partitionBy(SRC).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0)))
    reached = buckets.join(totals.withColumnRenamed(SRC, own("s2")), F.col(SRC).eqNullSafe(F.col(own("s2")))).where(F.col("before") <= F.col("wanted"))
    edge = reached.groupBy(SRC).agg(F.max(F.struct(BUCKET, "before", "wanted")).alias("e")).select(F.col(SRC).alias(own("s2")), "e.*").withColumnRenamed(BUCKET, own("b2"))
    edge = materialise(edge, "edges")
    inside = narrow.join(edge, F.col(SRC).eqNullSafe(F.col(own("s2"))) & (F.col(BUCKET) == F.col(own("b2"))))
    ties = inside.groupBy(SRC, KEY, "before", "wanted").agg(F.sum(SIZE).alias("sum"))
    upto = F.col("before") + F.coalesce(F.sum("sum").over(Window.partitionBy(SRC).orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ties.withColumn("upto", upto).where(2 * F.col("upto") + F.col("sum") <= 2 * F.col("wanted")).groupBy(SRC).agg(F.max(KEY).alias("last_key")).select(F.col(SRC).alias(own("s3")), "last_key")
    edge = edge.join(last, F.col(own("s2")).eqNullSafe(F.col(own("s3"))), "left").select(own("s2"), F.col(own("b2")).alias("edge"), "last_key")
    return materialise(totals.join(edge, F.col(SRC).eqNullSafe(F.col(own("s2"))), "left").select(F.col(SRC).alias(own("of")), "source_size", "target", "whole", "edge", "last_key"), "repeats")


def _times(key: str, bucket: Column) -> Column:
    once_more = F.coalesce((bucket < F.col("edge")) | ((bucket == F.col("edge")) & (F.col(key) <= F.col("last_key"))), F.lit(False))
    return F.col("whole") + once_more.cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, repeats."""
    narrow = materialise(sized(docs, id_col, text_col, source_col, seed), "sized")
    per_source = repetitions(narrow, **how)
    joined = narrow.join(per_source, F.col(SRC).eqNullSafe(F.col(own("of"))))
    times = _times(KEY, F.substring(KEY, 1, 3))
    return joined.select(F.col(ID).alias(id_col), F.col(SIZE).alias("size"), "source_size", "target", (F.col(SIZE) * times).alias("taken"), times.alias("repeats"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. The text stays where it is; only the row per source travels."""
    narrow = materialise(sized(docs, id_col, text_col, source_col, seed), "sized")
    per_source = repetitions(narrow, **how).select([F.col(c).alias(c if c.startswith(own("")) else own(c)) for c in ("__tw_of", "whole", "edge", "last_key")])
    keyed = docs.withColumn(KEY, order_key(id_col, text_col, seed))
    joined = keyed.join(per_source, F.col(source_col).cast("string").eqNullSafe(F.col(own("of"))))
    bucket = F.substring(KEY, 1, 3)
    once_more = F.coalesce((bucket < F.col(own("edge"))) | ((bucket == F.col(own("edge"))) & (F.col(KEY) <= F.col(own("last_key")))), F.lit(False))
    times = (F.col(own("whole")) + once_more.cast("long")).cast("int")
    return joined.withColumn(own("n"), F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {
    "op5_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM f) - coalesce(sum(cap) OVER b, 0))
            / ((SELECT sum(weight) FROM f) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT level FROM l WHERE level <= fill ORDER BY fill LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM g) * weight), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS wanted,
         sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, k) AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), x AS (SELECT *, whole + CASE WHEN 2 * (upto - own) + own <= 2 * wanted THEN 1 ELSE 0 END AS repeats FROM r)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, CAST(repeats AS BIGINT) AS repeats FROM x
""",
}
