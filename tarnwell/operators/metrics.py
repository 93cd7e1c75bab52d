"""Metrics over (y, p) columns as aggregates; each function returns a one-row frame with one column named for it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

BINS, TOP_PERCENTS = 15, (1, 2, 5, 10, 20)


def _y() -> Column:
    return F.col("y").cast("double")


def _p() -> Column:
    return F.col("p").cast("double")


#: Metrics that are plain aggregates of y and p.
AGGREGATES = {
    "rmse": lambda: F.sqrt(F.avg((_y() - _p()) * (_y() - _p()))),
    "mae": lambda: F.avg(F.abs(_y() - _p())),
    "mape": lambda: F.avg(F.when(F.abs(_y()) > 1e-9, F.abs((_y() - _p()) / _y()))),
    "smape": lambda: F.avg(F.when(F.abs(_y()) + F.abs(_p()) > 0, F.abs(_y() - _p()) / ((F.abs(_y()) + F.abs(_p())) / 2))),
    "r2": lambda: 1 - F.sum((_y() - _p()) * (_y() - _p())) / F.coalesce(F.nullif(F.regr_syy(_y(), _y()), F.lit(0.0)), F.lit(1.0)),
    "log_loss": lambda: -F.avg(F.when(_y() == 1, F.ln(_clipped())).otherwise(F.ln(1 - _clipped()))),
    "brier": lambda: F.avg((_y() - _p()) * (_y() - _p())),
}


def _clipped() -> Column:
    return F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), _p()))


def plain(df: DataFrame, names: list[str]) -> DataFrame:
    """All named aggregates in one pass."""
    return df.agg(*[AGGREGATES[n]().alias(n) for n in names])


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: what ranking metrics need of the rows."""
    return df.groupBy(_p().alias("p")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Rank-sum form with ties at half; null for a single class."""
    won = running(_by_score(df), "p", {"below": F.col("neg")}).select("pos", "neg", (F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"))
    return won.agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Steps of recall times precision at each distinct score."""
    t = running(_by_score(df), "p", {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, descending=True)
    tp, n = F.col("tp") + F.col("pos"), F.col("n") + F.col("pos") + F.col("neg")
    return t.agg(F.try_divide(F.sum(F.col("pos") * (tp / n)), F.sum("pos").cast("double")).alias("average_precision"))


def top_rows(df: DataFrame, n: int, tiebreak: str = "id") -> DataFrame:
    """The n rows of highest score; a top-n operator, not a sort of all rows."""
    return df.orderBy(F.desc("p"), tiebreak).limit(n)


def precision_at(df: DataFrame, k: int = 10) -> DataFrame:
    return top_rows(df, k).agg(F.avg(_y()).alias("precision_at_k"))


def top_percent(df: DataFrame, percents: tuple[int, ...] = TOP_PERCENTS, tiebreak: str = "id") -> DataFrame:
    """recall, precision and lift of the best-scored hundredths: a row for each percentage. Sizes are rounded half to even.

    Places come from running sums over ranges of scores and, where many rows have one score, of the tiebreak, so the best rows never meet in one task.
    """
    rows = df.select(_y().alias("y"), _p().alias("p"), tiebreak)
    placed = running(rows, "p", {"place": F.lit(1).cast("long")}, then=[tiebreak], descending=True, ties=True)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    sizes = total.select("n", "positives", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    sizes = sizes.where("n > 0").withColumn("size", F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("percent") / 100.0 * F.col("n")).cast("long"))))
    # One row for each percentage; a row of data is in the shares of those whose size is above its place.
    shares = sizes.groupBy().agg(F.collect_list(F.struct("percent", "size", "positives", "n")).alias("shares"))
    within = placed.join(F.broadcast(shares)).select("y", F.explode(F.filter("shares", lambda x: x["size"] > F.col("place"))).alias("x"))
    hit = within.groupBy("x").agg(F.sum("y").alias("hit")).select("x.*", "hit")
    positives, precision = F.col("positives"), F.try_divide(F.col("hit"), F.col("size").cast("double"))
    return hit.select("percent", F.try_divide(F.col("hit"), positives).alias("recall"), precision.alias("precision"), F.try_divide(precision, positives / F.col("n")).alias("lift"))


def ece(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal bins; null if a score lies outside [0, 1]."""
    at = F.least(F.floor(_p() * bins), F.lit(bins - 1))
    t = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(_y()).alias("y"), F.avg(_p()).alias("p"), F.min(_p()).alias("lo"), F.max(_p()).alias("hi"))
    value = F.try_divide(F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))), F.sum("n").cast("double"))
    return t.agg(F.when((F.min("lo") >= 0) & (F.max("hi") <= 1), value).alias("ece"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """The points of a calibration curve."""
    at = F.least(F.floor(_p() * bins), F.lit(bins - 1))
    return df.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(_y()).alias("observed"), F.avg(_p()).alias("predicted"))


def ndcg(df: DataFrame, k: int = 10) -> DataFrame:
    """Gains 2^y - 1 of the k best-scored rows over those of the k best rows."""

    def gain(rows: DataFrame, order: list) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))
        return rows.withColumn("place", place).agg(F.sum((F.pow(F.lit(2.0), _y()) - 1) / F.log2(F.col("place") + 1.0)).alias("gain"))

    got = gain(top_rows(df, k), [F.desc("p"), "id"]).withColumnRenamed("gain", "got")
    best = gain(df.orderBy(F.desc("y"), "id").limit(k), [F.desc("y"), "id"]).withColumnRenamed("gain", "best")
    return got.join(F.broadcast(best)).select(F.try_divide("got", "best").alias("ndcg"))  # one row each


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a column with its average rank, from counts per value."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "v", {"before": F.col("n")}).select("v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame) -> DataFrame:
    """Pearson's correlation of average ranks; 0 where there is none."""
    x, y = average_ranks(df, "y").toDF("vy", "ry"), average_ranks(df, "p").toDF("vp", "rp")
    both = df.join(x, df["y"] == x["vy"]).join(y, df["p"] == y["vp"])
    sd = F.stddev_samp("ry") * F.stddev_samp("rp")
    return both.agg(F.coalesce(F.try_divide(F.covar_samp("ry", "rp"), sd), F.lit(0.0)).alias("spearman"))


def concordance(df: DataFrame) -> DataFrame:
    """Share of pairs with different times in which the shorter time has the higher risk, ties of risk not counted as concordant.

    Distinct times get places. Two places part at one level of the binary tree above them,
    so each row stands once a level in the half of a block, and in every block rows of the
    second half count the rows of the first that have a higher risk, by running sums: work
    is rows times the logarithm of the number of times, and no pair is made.
    """
    cells = df.groupBy(_y().alias("y"), _p().alias("p")).agg(F.count(F.lit(1)).alias("n")).where("y is not null and p is not null")
    times = cells.groupBy("y").agg(F.sum("n").alias("of_time"))
    placed = running(times, "y", {"place": F.lit(1).cast("long"), "before": F.col("of_time")})
    comparable = placed.agg(F.sum(F.col("of_time") * F.col("before")).alias("all"))
    levels = max(1, (max(1, times.count()) - 1).bit_length())
    rows = cells.join(placed.select(F.col("y").alias("t"), "place"), F.col("y") == F.col("t")).select("p", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    second = F.expr("(shiftright(place, level) & 1) = 1")
    halves = rows.groupBy("level", F.expr("shiftright(place, level + 1)").alias("block"), "p").agg(F.sum(F.when(second, F.lit(0)).otherwise(F.col("n"))).alias("first"), F.sum(F.when(second, F.col("n")).otherwise(F.lit(0))).alias("second"))
    counted = running(halves, "p", {"higher": F.col("first")}, by=["level", "block"], descending=True)
    right = counted.agg(F.sum(F.col("second") * F.col("higher")).alias("right"))
    return right.join(F.broadcast(comparable)).select(F.try_divide(F.col("right").cast("double"), F.col("all").cast("double")).alias("concordance"))


def _nothing(name: str):
    """A metric that is named but not defined: null."""
    return lambda df: df.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))


#: Metrics by name, beside AGGREGATES and TOP.
NAMED = {
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "precision_at_k": precision_at,
    "ece": ece,
    "expected_calibration_error": ece,
    "ndcg": ndcg,
    "ndcg_at_10": ndcg,
    "spearman": spearman,
    "spearman_rank_corr": spearman,
    "concordance": concordance,
    "concordance_index": concordance,
    "ibs": _nothing("ibs"),
    "cumulative_dynamic_auc": _nothing("cumulative_dynamic_auc"),
}
#: What a name of the best hundredths means: the column of top_percent and the percentage.
TOP = {f"{c}_at_top_pct_{percent}": (c, percent) for percent in TOP_PERCENTS for c in ("recall", "precision", "lift")}
TOP |= {f"{c}_at_top_k": (c, 10) for c in ("recall", "precision", "lift")} | {"top_k_capture_rate": ("recall", 10)}


def named(name: str):
    """The function of a metric's name, or None."""
    if name in AGGREGATES:
        return lambda df: plain(df, [name])
    if name in TOP:
        column, percent = TOP[name]
        return lambda df: top_percent(df, (percent,)).select(F.col(column).alias(name))
    return NAMED.get(name)


def focal_loss(df: DataFrame, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    p = _clipped()
    value = F.when(_y() == 1, -alpha * F.pow(1 - p, F.lit(gamma)) * F.ln(p)).otherwise(-(1 - alpha) * F.pow(p, F.lit(gamma)) * F.ln(1 - p))
    return df.agg(F.avg(value).alias("focal_loss"))


def check_metrics(values: dict[str, float | None], train: dict[str, float | None] | None = None, n_features: int = 10**9, primary: str | None = None, strict: bool = False) -> dict:
    """The sceptic's verdict: FAIL for non-finite or impossible values, WARN (strict: FAIL) for a wide train gap or for scores too good with few features."""
    failed, warned = [], []
    finite = {k: v for k, v in values.items() if v is not None and math.isfinite(v)}
    if primary and primary not in finite:
        failed.append("finite_metric")
    if any(v is not None and not math.isfinite(v) for v in values.values()):
        failed.append("nan_metrics")
    unit = ("roc_auc", "average_precision", "brier", "ece", "expected_calibration_error", "ndcg", "ndcg_at_10", "concordance", "concordance_index")
    if any(not -1e-9 <= finite[k] <= 1 + 1e-9 for k in unit if k in finite):
        failed.append("metric_in_range")
    if train and primary in finite and train.get(primary) is not None and abs(train[primary] - finite[primary]) > 0.25:
        warned.append("train_val_gap")
    if finite.get("roc_auc", 0) >= 0.99 and n_features < 10:
        warned.append("too_good_to_be_true")
    if strict:
        failed, warned = failed + warned, []
    return {"verdict": "FAIL" if failed else "WARN" if warned else "ACCEPT", "failed": failed, "warnings": warned}
