"""Row weights, deterministic weighted samples and fold columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import quantiles, ranked

ROWS = 5000


def _mean_one(df: DataFrame, weight: Column) -> DataFrame:
    """df with ``weight`` scaled to a mean of 1: the mean is one row, which is broadcast."""
    weighed = df.withColumn("weight", weight)
    mean = weighed.agg(F.avg("weight").alias("__mean"))
    return weighed.join(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("__mean")).drop("__mean")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """1 / size of the row's class, mean 1. Sizes are aggregated and joined, so no class is one task's."""
    sizes = df.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    joined = df.join(sizes, F.col(target).eqNullSafe(F.col("__class")))
    return _mean_one(joined, 1.0 / F.col("__n")).drop("__class", "__n")


def median_of(df: DataFrame, value: str) -> DataFrame:
    """One row and column, median: exact, from counts of values and their running sums."""
    cells = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return quantiles(cells, "v", "n", (0.5,)).select(F.col("quantiles")[0].alias("median"))


def regression_weights(df: DataFrame, target: str) -> DataFrame:
    """1 + distance from the median over the median distance (0 counts as 1), mean 1."""
    middle = median_of(df, target).select(F.col("median").alias("__median"))
    off = df.join(F.broadcast(middle)).withColumn("__off", F.abs(F.col(target) - F.col("__median")))
    mad = median_of(off, "__off").select(F.coalesce(F.nullif("median", F.lit(0.0)), F.lit(1.0)).alias("__mad"))
    return _mean_one(off.join(F.broadcast(mad)), 1 + F.col("__off") / F.col("__mad")).drop("__median", "__off", "__mad")


def recency_weights(df: DataFrame, time: str) -> DataFrame:
    """0.1 to 2.0 by dense rank of time, mean 1. Ranks are of distinct times only."""
    times = df.select(F.col(time).alias("__t")).distinct()
    ranks = ranked(times, "__t", name="__rank")
    top = times.agg((F.count(F.lit(1)) - 1).alias("__top"))
    joined = df.join(ranks, F.col(time).eqNullSafe(F.col("__t"))).join(F.broadcast(top))
    return _mean_one(joined, 0.1 + 1.9 * F.coalesce(F.try_divide("__rank", "__top"), F.lit(1.0))).drop("__t", "__rank", "__top")


def weights_for(df: DataFrame, target_type: str, target: str | None = None, time: str | None = None) -> DataFrame:
    """Weights that suit what is predicted: of classes for a binary target, of distance from the median for a continuous one, of recency for survival; else 1, as without the column needed."""
    numeric = target in df.columns and isinstance(df.schema[target].dataType, T.NumericType)
    if target_type == "binary" and target in df.columns:
        return class_weights(df, target)
    if target_type == "continuous" and numeric:
        return regression_weights(df, target)
    if target_type == "survival" and time in df.columns:
        return recency_weights(df, time)
    return df.withColumn("weight", F.lit(1.0))


def weighted_sample(df: DataFrame, weight: str, key: Sequence[str], rows: int = ROWS, seed: int = 0) -> DataFrame:
    """Rows drawn without replacement, likelier by weight: the smallest -ln(u)/weight, u from a hash of the key.

    The draw depends on keys and seed only, not on partitions; a top-n operator finds it without a sort of all rows.
    """
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    drawn = df.withColumn("__draw", -F.ln(u) / F.col(weight)).orderBy("__draw", *key).limit(rows).drop("__draw")
    total = drawn.agg(F.sum(weight).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    return drawn.join(F.broadcast(total)).withColumn(weight, F.col(weight) * F.col("__n") / F.col("__sum")).drop("__sum", "__n")


def stratified_folds(df: DataFrame, target: str, order: str, k: int = 5) -> DataFrame:
    """df with fold: by turns within each class, in the order of a number or time; a class is cut into ranges, so none is one task's."""
    return ranked(df, order, by=[target], name="__place").withColumn("fold", F.pmod(F.col("__place"), F.lit(k)).cast("int")).drop("__place")


def hashed_fold(key: Sequence[str], k: int = 5, seed: int = 0) -> Column:
    """Fold by hash: no shuffle, at any size; rows of one group share a fold if the key is the group."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(k)).cast("int")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """group and fold: larger groups first, dealt to and fro, so that folds are of like sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    turn = F.pmod(F.col("place"), F.lit(2 * k))
    return ranked(sizes.withColumn("__less", -F.col("n")), "__less", then=[group], ties=True).select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def time_folds(df: DataFrame, time: str, key: str, splits: int = 5, parts: int = 6, gap: int = 0) -> DataFrame:
    """key, fold and role (train or valid) of an expanding split: fold i trains on the first i parts and validates on the next, gap rows later."""
    total = df.agg(F.floor(F.count(F.lit(1)) / parts).alias("chunk"))
    placed = ranked(df.select(key, time), time, then=[key], ties=True).join(F.broadcast(total)).select(key, (F.col("place") + 1).alias("place"), "chunk")
    folds = placed.select(key, "place", "chunk", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold"))
    start, end = F.col("fold") * F.col("chunk"), F.col("fold") * F.col("chunk") + gap
    role = F.when(F.col("place") <= start, F.lit("train")).when((F.col("place") > end) & (F.col("place") <= end + F.col("chunk")), F.lit("valid"))
    return folds.select(key, "fold", role.alias("role")).where("role is not null")


def positional_split(df: DataFrame, time: str, key: str, share: float = 0.8) -> DataFrame:
    """df with role: the first share of the rows in time order train, the others valid."""
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("__train"))
    placed = ranked(df, time, then=[key], name="__place", ties=True).join(F.broadcast(total))
    return placed.withColumn("role", F.when(F.col("__place") < F.col("__train"), F.lit("train")).otherwise(F.lit("valid"))).drop("__place", "__train")
