"""Series ordered by time: moving profiles, symbolic words, gaps, forecasts, change points and regimes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.saved import Saved

from .running import carried, ranked

WINDOW = 64
#: Rows of a range of cusum, windows of a block of the matrix profile, and digits of correlations that are compared.
BLOCK, TILE, DIGITS = 65_536, 4096, 10
#: Rows of a series up to which pelt is tried.
PELT_ROWS = 5000


def _frames(rows: DataFrame, time: str, by: list[str], window: int, hot: bool, then: Sequence[str] = ()) -> tuple[DataFrame, Window, Column]:
    """rows, the window of a row and those that follow it, and which rows' windows count; rows of one time stand by the columns in then.

    Without by, or with hot, series are cut into blocks, and a block's last windows reach
    into copies of the next block's first rows, whose own windows do not count.
    """
    if by and not hot:
        return rows, Window.partitionBy(*by).orderBy(time, *then).rowsBetween(0, window - 1), F.lit(True)
    size = max(BLOCK, window)
    block = F.floor(F.col("__place") / size)
    copied = (F.col("__place") % size < window - 1) & (block > 0)
    placed = ranked(rows, time, then, by=by, name="__place").withColumn("__of", block)
    blocks = placed.withColumn("__block", F.explode(F.when(copied, F.array(block, block - 1)).otherwise(F.array(block))))
    return blocks, Window.partitionBy(*by, "__block").orderBy("__place").rowsBetween(0, window - 1), F.col("__block") == F.col("__of")


def _with_totals(rows: DataFrame, by: list[str], hot: bool, totals: dict[str, Column], order: Sequence[str] = ()) -> DataFrame:
    """rows with aggregates over their series, by a window (in order, if given, so that sums are the same in each run) or, without by or with hot, by an aggregation."""
    if by and not hot:
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.withColumns({n: e.over(whole) for n, e in totals.items()})
    found = rows.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]).agg(*[e.alias(n) for n, e in totals.items()])
    return rows.join(found if by else F.broadcast(found), _same(by)).drop(*[f"__of_{i}" for i in range(len(by))])


def moving_profile(df: DataFrame, time: str, value: str, by: list[str] | None = None, window: int = WINDOW, hot: bool = False) -> DataFrame:
    """start time, window mean and distance of the mean from the mean of all windows; for full windows only. hot says that a series may hold much of the table."""
    by = by or []
    rows, frame, counts = _frames(df.where(F.col(value).isNotNull()).select(*by, time, value), time, by, window, hot)
    means = rows.select(*by, time, F.avg(value).over(frame).alias("window_mean"), F.count(value).over(frame).alias("n"), counts.alias("__counts")).where((F.col("n") == window) & F.col("__counts"))
    return _with_totals(means, by, hot, {"__mean": F.avg("window_mean")}).select(*by, time, "window_mean", F.abs(F.col("window_mean") - F.col("__mean")).alias("distance"))


def sax_words(df: DataFrame, time: str, value: str, by: list[str], window: int = WINDOW, letters: int = 4, length: int = 8, hot: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """by columns, word and n: the symbolic words of all sliding windows, standardised per series; hot as in moving_profile, rows of one time stand by the columns in then.

    A mean that lies on a cut falls to either side by its rounding, so series are summed in their order.
    """
    cuts = [NormalDist().inv_cdf(i / letters) for i in range(1, letters)]
    known = _with_totals(df.where(F.col(value).isNotNull()).select(*by, time, *then, value), by, hot, {"__mean": F.avg(value), "__sd": F.stddev_samp(value)}, [time, *then])
    z = F.coalesce(F.try_divide(F.col(value) - F.col("__mean"), F.nullif("__sd", F.lit(0.0))), F.lit(0.0))
    rows, frame, counts = _frames(known.select(*by, time, *then, z.alias("z")), time, by, window, hot, then)
    rows = rows.withColumns({"w": F.collect_list("z").over(frame), "__counts": counts}).where((F.size("w") == window) & F.col("__counts"))
    # Chunks as equal as may be, the longer ones first.
    sizes = [window // length + (i < window % length) for i in range(length)]
    starts = [sum(sizes[:i]) + 1 for i in range(length)]
    means = [F.aggregate(F.slice("w", s, n), F.lit(0.0), lambda a, x: a + x) / n for s, n in zip(starts, sizes, strict=True)]
    letter = [F.element_at(F.array(*[F.lit(chr(97 + i)) for i in range(letters)]), sum(((m > c).cast("int") for c in cuts), F.lit(1))) for m in means]
    return rows.groupBy(*by, F.concat(*letter).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _same(by: list[str], prefix: str = "__of_") -> Column:
    """Equal keys, nulls too; those of the other side have a prefix and their place."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(by)], F.lit(True))


def filled(df: DataFrame, time: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Gaps take the last known value, and before the first one the first; in ranges of time, so that no series is one task."""
    by = by or []
    known = F.struct(F.col(time).alias("at"), F.col(value).alias("value"))
    first = df.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]).agg(F.min(F.when(F.col(value).isNotNull(), known)).alias("__first"))
    last = carried(df, time, {"__last": F.col(value)}, by)
    rows = last.join(first if by else F.broadcast(first), _same(by), "left")
    return rows.withColumn(value, F.coalesce("__last", "__first.value")).select(*df.columns)


def naive_seasonal(df: DataFrame, time: str, value: str, horizon: int, period: int = 7) -> DataFrame:
    """step and forecast: the last period's values in turn."""
    tail = df.where(F.col(value).isNotNull()).orderBy(F.desc(time)).limit(period)
    place = tail.select(F.row_number().over(Window.orderBy(time)).alias("place"), F.col(value).alias("forecast"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    steps = df.sparkSession.range(horizon).select(F.col("id").alias("step"))
    return steps.join(F.broadcast(place.withColumn("n", n)), F.pmod("step", "n") == F.col("place") - 1).select("step", "forecast")


def cusum(values: np.ndarray, k: float = 0.5, h: float = 4.0) -> list[int]:
    """Alarms of a two-sided cumulative sum on the standardised values, both sums starting anew after one; none for fewer than 20."""
    if len(values) < 20 or not values.std():
        return []
    up = down = 0.0
    alarms = []
    for i, z in enumerate((values - values.mean()) / values.std()):
        up, down = max(0.0, up + z - k), max(0.0, down - z - k)
        if max(up, down) > h:
            alarms.append(i)
            up = down = 0.0
    return alarms


def pelt_rbf(values: np.ndarray, penalty: float = 10.0, least: int = 2) -> list[int]:
    """Change points of exact penalised segmentation with a Gaussian kernel's cost; memory grows with the square of the length."""
    n = len(values)
    gaps = (values[:, None] - values[None, :]) ** 2
    middle = np.median(gaps[np.triu_indices(n, 1)]) if n > 1 else 0.0
    kernel = np.exp(-np.clip(gaps / (middle or 1.0), 0.01, 100))
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = kernel.cumsum(0).cumsum(1)
    diagonal = np.concatenate([[0.0], np.cumsum(np.diag(kernel))])
    best, before, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for end in range(least, n + 1):
        starts = np.array([s for s in open_ if end - s >= least])
        if not len(starts):
            continue
        block = area[end, end] - area[starts, end] - area[end, starts] + area[starts, starts]
        cost = best[starts] + diagonal[end] - diagonal[starts] - block / (end - starts)
        i = int(np.argmin(cost))
        best[end], before[end] = cost[i] + penalty, starts[i]
        open_ = [s for s, c in zip(starts, cost, strict=True) if c <= best[end]] + [s for s in open_ if end - s < least] + [end - least + 1]
    points, at = [], n
    while at > 0 and before[at] > 0:
        points.append(int(before[at]))
        at = before[at]
    return points[::-1]


def regime_bounds(alarms: list[int], n: int, most: int = 8) -> list[int]:
    """Alarms that leave regimes of at least max(50, 5 %) rows, at most ``most`` regimes."""
    least = max(50, int(0.05 * n))
    kept: list[int] = []
    for a in alarms:
        if a - (kept[-1] if kept else 0) >= least:
            kept.append(a)
    while kept and n - kept[-1] < least:
        kept.pop()
    return kept[: most - 1]


def _scan(up: float, down: float, z: np.ndarray, k: float = 0.5, h: float = 4.0) -> tuple[float, float, list[int]]:
    """Both sums after a range that they enter with up and down, and the places of its alarms."""
    alarms = []
    for i, x in enumerate(z.tolist()):
        up, down = max(0.0, up + x - k), max(0.0, down - x - k)
        if max(up, down) > h:
            alarms.append(i)
            up = down = 0.0
    return up, down, alarms


def cusum_alarms(df: DataFrame, time: str, value: str, by: list[str], block: int = BLOCK) -> DataFrame:
    """by columns, place and n: the alarms of cusum in series of n rows of any length, cut into ranges of block rows.

    A range is a map from the sums that enter it to those that leave it. All ranges are
    mapped from zeros at once; then those whose entering sums turn out to be others are
    mapped again, until none is. Sums fall back to zero all the time, so what enters a
    range seldom tells at its end and few rounds are needed; there are never more than a
    series has ranges, and the alarms are the loop's in any case. A task has a range.
    """
    spark = df.sparkSession
    rows = df.select(*by, time, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v"))
    rows = filled(rows, time, "v", by).withColumn("v", F.coalesce("v", F.lit(0.0)))
    key = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    moments = rows.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).where("n >= 20 AND sd > 0")
    placed = ranked(rows, time, ["v"], by).join(moments, _same(by))
    cut = placed.groupBy(key.alias("series"), F.floor(F.col("place") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z")))).alias("z"), F.any_value(F.struct(*by, "n")).alias("of"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column(4)
            found = [_scan(up.as_py(), down.as_py(), z[i].values.to_numpy(zero_copy_only=False)) for i, (up, down) in enumerate(zip(batch.column(2), batch.column(3), strict=True))]
            sums = [pa.array([f[j] for f in found], pa.float64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *sums, pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["series", "block", "up", "down", "up_out", "down_out", "alarms"])

    def entered(ranges: DataFrame) -> DataFrame:
        return ranges.select("series", "block", "up", "down", F.col("z.z").alias("z")).mapInArrow(mapped, "series string, block long, up double, down double, up_out double, down_out double, alarms array<int>")

    with Saved(spark) as saved:
        ranges = saved(cut)
        states = saved(entered(ranges.withColumns({"up": F.lit(0.0), "down": F.lit(0.0)})))
        # A row for each range, without its values.
        order = Window.partitionBy("series").orderBy("block")
        while True:
            entering = {s: F.coalesce(F.lag(f"{s}_out").over(order), F.lit(0.0)) for s in ("up", "down")}
            moved = states.select("series", "block", *[e.alias(f"{s}_in") for s, e in entering.items()], "up", "down").where("up_in <> up OR down_in <> down")
            moved = saved(moved.select("series", "block", F.col("up_in").alias("up"), F.col("down_in").alias("down")))
            if moved.isEmpty():
                break
            again = entered(ranges.join(moved, ["series", "block"]))
            states = saved(states.join(moved, ["series", "block"], "left_anti").unionByName(again))
        alarms = states.where(F.size("alarms") > 0).join(ranges.select("series", "block", "of"), ["series", "block"])
        return saved(alarms.select("of.*", F.explode("alarms").alias("at"), "block").select(*by, (F.col("block") * block + F.col("at")).alias("place"), "n"), keep=True)


def spaced(alarms: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """by columns and place of the alarms that leave regimes of at least max(50, 5 %) rows, at most ``most`` regimes, as regime_bounds; a step for each regime, so that no series' alarms meet in one task."""
    least = F.greatest(F.lit(50), F.floor(F.col("n") * 0.05))
    open_ = alarms.where(F.col("n") - F.col("place") >= least).withColumn("__least", least)
    names = [F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]
    with Saved(alarms.sparkSession) as saved:
        after = open_.withColumn("__after", F.lit(0).cast("long"))
        steps = []
        for _ in range(most - 1):
            step = saved(after.where(F.col("place") - F.col("__after") >= F.col("__least")).groupBy(*names).agg(F.min("place").alias("__after")))
            steps.append(step)
            if step.isEmpty():
                break
            after = open_.join(step, _same(by)).drop(*[f"__of_{i}" for i in range(len(by))])
        found = reduce(DataFrame.unionByName, steps)
        return saved(found.select(*[F.col(f"__of_{i}").alias(c) for i, c in enumerate(by)], F.col("__after").alias("place")), keep=True)


def change_points(df: DataFrame, time: str, value: str, by: list[str], method: str = "cusum", pelt_rows: int = PELT_ROWS, block: int = BLOCK) -> DataFrame:
    """by columns, place of the regimes' bounds and the method that found them.

    cusum takes series of any length, in ranges. pelt's cost needs memory of the square of
    a series' length, so series of over pelt_rows are searched by cusum; method says so.
    Rows of one time stand by value, gaps take the last known value, and a series without
    any value is 0 throughout and has no bounds.
    """
    if method == "cusum":
        return spaced(cusum_alarms(df, time, value, by, block), by).withColumn("method", F.lit("cusum"))
    names = [F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]
    long = df.groupBy(*names).count().where(F.col("count") > pelt_rows)
    short = df.join(long, _same(by), "left_anti")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([time, value])
        v = part[value].astype(float).ffill().bfill().fillna(0.0).to_numpy()
        places = regime_bounds(pelt_rbf(v), len(v))
        return pd.DataFrame({**{c: [part[c].iloc[0]] * len(places) for c in by}, "place": places}).astype({"place": "int64"})

    kinds = dict(df.dtypes)
    exact = short.select(*by, time, value).groupBy(*by).applyInPandas(scan, ", ".join(f"{c} {kinds[c]}" for c in by) + ", place long").withColumn("method", F.lit("pelt"))
    rest = df.join(long, _same(by), "left_semi")
    return exact if long.isEmpty() else exact.unionByName(change_points(rest, time, value, by, block=block))


def regime_summary(df: DataFrame, time: str, value: str, bounds: list[int]) -> DataFrame:
    """Size, mean, deviation and share above 0 of a value by regime, the regimes bounded by row places in time order."""
    regime = sum(((F.col("place") >= b).cast("int") for b in bounds), F.lit(0))
    return ranked(df.select(time, value), time).withColumn("regime", regime).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.avg((F.col(value) > 0).cast("double")).alias("rate"))


def regime_classes(df: DataFrame, time: str, label: str, bounds: list[int]) -> DataFrame:
    """regime, n, top (its most frequent label, the first of equally frequent ones), rate (top's share) and n_unique; labels are counted first."""
    regime = sum(((F.col("place") >= b).cast("int") for b in bounds), F.lit(0))
    counts = ranked(df.select(time, label), time).withColumn("regime", regime).groupBy("regime", label).agg(F.count(F.lit(1)).alias("k"))
    most = F.max(F.when(F.col(label).isNotNull(), F.col("k")))
    tops = counts.groupBy("regime").agg(F.sum("k").alias("n"), most.alias("most"), F.count(label).alias("n_unique"))
    named = counts.where(F.col(label).isNotNull()).withColumnsRenamed({"regime": "__of", "k": "__k"})
    first = tops.join(named, (F.col("regime") == F.col("__of")) & (F.col("most") == F.col("__k")), "left")
    return first.groupBy("regime").agg(F.max("n").alias("n"), F.min(label).alias("top"), (F.max("most") / F.max("n")).alias("rate"), F.max("n_unique").alias("n_unique"))


def _standard(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised windows over the root of their length, so that products are correlations, and which windows are flat."""
    centred = windows - windows.mean(axis=1, keepdims=True)
    sd = windows.std(axis=1)
    flat = sd < 1e-12
    return centred / np.where(flat, 1.0, sd * np.sqrt(windows.shape[1]))[:, None], flat


def _tile(left: np.ndarray, right: np.ndarray, left_at: int, right_at: int, m: int, rows: int = 512) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the windows of each side the greatest correlation with one of the other side and its place, the first of equal ones; windows that overlap by three quarters or more don't count."""
    (a, flat_a), (b, flat_b) = (_standard(np.lib.stride_tricks.sliding_window_view(v, m)) for v in (left, right))
    best_a, at_a = np.full(len(a), -np.inf), np.zeros(len(a), np.int64)
    best_b, at_b = np.full(len(b), -np.inf), np.zeros(len(b), np.int64)
    places = right_at + np.arange(len(b))
    for i in range(0, len(a), rows):
        r = a[i : i + rows] @ b.T
        # Two flat windows are equal; a flat one and another are at the distance of the root of m.
        r[flat_a[i : i + rows]] = 0.5
        r[:, flat_b] = np.where(flat_a[i : i + rows, None], 1.0, 0.5)
        r = np.round(np.clip(r, -1.0, 1.0), DIGITS)
        mine = left_at + i + np.arange(len(r))
        r[np.abs(mine[:, None] - places) <= -(-m // 4)] = -np.inf
        j = r.argmax(axis=1)
        best_a[i : i + rows], at_a[i : i + rows] = r[np.arange(len(r)), j], places[j]
        k = r.argmax(axis=0)
        better = r[k, np.arange(len(b))] > best_b
        best_b[better], at_b[better] = r[k, np.arange(len(b))][better], mine[k][better]
    return (best_a, at_a), (best_b, at_b)


def matrix_profile(values: np.ndarray, m: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of each window's nearest other window, standardised, with an exclusion zone of a quarter window; in linear memory."""
    (best, place), _ = _tile(values, values, 0, 0, m)
    return np.where(np.isfinite(best), np.sqrt(2 * m * (1 - np.maximum(best, -1.0))), np.inf), place


def nearest_windows(df: DataFrame, time: str, value: str, by: list[str], window: int = WINDOW, block: int = TILE) -> DataFrame:
    """by columns, place, match and distance of each window of a series: the matrix profile, in tiles.

    A series is cut into blocks of windows, each with the values that its last windows
    reach into. Every two blocks meet once, in a tile, whose correlations are products of
    matrices, so the square of a series' length is work but never memory; a block meets
    half of the blocks after it, in a ring, so tiles are dealt evenly. For each block the
    best of its tiles is kept as they stream by. Series of under two windows have no rows.
    """
    block = max(block, window)
    key = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    rows = df.select(*by, time, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL")
    sizes = rows.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]).agg(F.count("v").alias("n")).where(F.col("n") >= 2 * window)
    placed = ranked(rows, time, ["v"], by).join(sizes, _same(by))
    at = F.floor(F.col("place") / block).cast("long")
    # A value is in its own block, and in the one before if windows reach into it from there.
    mine = F.when((at > 0) & (F.col("place") % block < window - 1), F.array(at, at - 1)).otherwise(F.array(at))
    cut = placed.select(key.alias("series"), F.struct(*by).alias("of"), "n", "place", "v", F.explode(mine).alias("block")).where(F.col("block") * block + window <= F.col("n"))
    cut = cut.groupBy("series", "block").agg(F.array_sort(F.collect_list(F.struct("place", "v")))["v"].alias("v"), F.any_value("of").alias("of"), F.any_value(F.ceil((F.col("n") - window + 1) / block).cast("long")).alias("blocks"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                series, a, b = (batch.column(c)[i].as_py() for c in range(3))
                left, right = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                sides = _tile(left, right, a * block, b * block, window)
                found = [(a, sides[0]), (b, sides[1])][: 1 if a == b else 2]
                yield pa.RecordBatch.from_arrays([pa.array([series] * len(found)), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1][0] for f in found], pa.list_(pa.float64())), pa.array([f[1][1] for f in found], pa.list_(pa.int64()))], names=["series", "block", "best", "match"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()) for batch in batches for i in range(batch.num_rows))
        for (series, at), group in groupby(parts, itemgetter(0, 1)):
            _, _, r, match = next(group)
            for _, _, other, its in group:
                take = (other > r) | ((other == r) & (its < match))
                r, match = np.where(take, other, r), np.where(take, its, match)
            yield pa.RecordBatch.from_arrays([pa.array([series]), pa.array([at], pa.int64()), pa.array([r], pa.list_(pa.float64())), pa.array([match], pa.list_(pa.int64()))], names=["series", "block", "best", "match"])

    spark = df.sparkSession
    with Saved(spark) as saved:
        blocks = saved(cut)
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("blocks") / 2))).alias("step")
        pairs = blocks.select("series", "block", "v", "blocks", step).where((F.col("step") * 2 < F.col("blocks")) | (F.col("block") < F.col("step")))
        pairs = pairs.withColumn("other", F.pmod(F.col("block") + F.col("step"), F.col("blocks")))
        right = blocks.select("series", F.col("block").alias("other"), F.col("v").alias("its"))
        met = pairs.join(right, ["series", "other"]).select("series", "block", "other", "v", "its")
        schema = "series string, block long, best array<double>, match array<long>"
        found = met.mapInArrow(tiles, schema).repartition("series", "block").sortWithinPartitions("series", "block").mapInArrow(best, schema)
        each = found.join(blocks.select("series", "block", "of"), ["series", "block"]).select("of.*", "block", F.posexplode(F.arrays_zip("best", "match")).alias("i", "w"))
        distance = F.sqrt(2 * window * (1 - F.col("w.best")))
        return saved(each.where(F.col("w.best") >= -1).select(*by, (F.col("block") * block + F.col("i")).alias("place"), F.col("w.match").alias("match"), distance.alias("distance")), keep=True)


def motifs_discords(df: DataFrame, time: str, value: str, by: list[str], window: int = WINDOW, k: int = 3, block: int = TILE) -> DataFrame:
    """by columns, kind, place, match and distance: the k windows nearest to and farthest from any other, the first of equal ones."""
    found = nearest_windows(df, time, value, by, window, block)
    kinds = []
    for kind, order in (("motif", F.asc("distance")), ("discord", F.desc("distance"))):
        first = found.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order, "place"))).where(F.col("__k") <= k)
        kinds.append(first.select(*by, F.lit(kind).alias("kind"), "place", "match", "distance"))
    return kinds[0].unionByName(kinds[1])
