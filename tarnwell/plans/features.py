"""The feature language: tokens become columns, with the columns each was made from."""

from __future__ import annotations

import logging
import math
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.operators.profile import numeric_columns
from tarnwell.operators.running import quantiles

log = logging.getLogger(__name__)

#: Periods by a hint in the column's name (fixed values).
PERIODS = {
    "hour": 24.0, "minute": 60.0, "second": 60.0, "dayofweek": 7.0, "day_of_week": 7.0, "dow": 7.0, "month": 12.0,
    "doy": 365.25, "day_of_year": 365.25, "week": 52.0, "theta": 360.0, "angle": 360.0, "phase": 360.0, "degree": 360.0,
}
INTERNAL = ("weight", "_weight", "__weight__")
MARK = "X__"


@dataclass(frozen=True)
class Context:
    """What the language needs to know of the task."""

    target: str | None = None
    time: str | None = None
    group: str | None = None
    forbidden: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    lag_policy: str = ""
    row_id: str | None = None
    fold: str | None = None
    interactions: tuple[tuple[str, str], ...] = ()
    closed: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "closed", frozenset(c for c in (self.target, self.time, self.group, self.row_id, self.fold, *self.forbidden, *INTERNAL) if c))

    def order(self) -> list[str]:
        return [c for c in (self.time, self.row_id) if c]


@dataclass
class Expanded:
    frame: DataFrame
    columns: list[str]
    lineage: dict[str, set[str]]

    def leaks(self, context: Context) -> list[str]:
        """Columns that come, however indirectly, from the target or a forbidden column."""
        bad = {context.target, *context.forbidden}
        return [c for c in self.columns if self.lineage.get(c, {c}) & bad]


def expand(df: DataFrame, tokens: list[str], context: Context) -> Expanded:
    """df with the engineered columns, and the ordered, distinct feature columns.

    Target, forbidden and internal columns are inputs of no engineered column. Lags
    go by time and row id, within the group, never by physical order.
    """
    out = Expanded(df, [], {})
    for token in tokens:
        kind, _, name = token.partition(":")
        if token == "+all_allowed":
            made = _allowed(df, context)
        elif token == "+lag_downstream":
            made = _lag_downstream(out, context)
        elif token == "+leak_canary":
            made = list(context.forbidden[:1])
        elif token == "sketch:top3_univariate":
            made = list(dict.fromkeys(c for pair in context.interactions for c in pair))[:3]
        elif kind == "engineered":
            made = _engineered(out, name, context)
        else:
            made = [token]
        out.columns += [c for c in made if c in out.frame.columns and c not in out.columns]
    return out


def _allowed(df: DataFrame, context: Context) -> list[str]:
    return list(context.allowed) or [c for c in df.columns if c not in context.closed and not c.startswith(MARK)]


def _numbers(out: Expanded, context: Context) -> list[str]:
    return [c for c in numeric_columns(out.frame) if c not in context.closed and not c.startswith(MARK)]


def _add(out: Expanded, made: dict[str, tuple[Column, set[str]]]) -> list[str]:
    out.frame = out.frame.withColumns({name: column for name, (column, _) in made.items()})
    for name, (_, sources) in made.items():
        out.lineage[name] = set().union(*(out.lineage.get(s, {s}) for s in sources))
    return list(made)


def _window(context: Context) -> Window:
    if not context.order():
        raise ValueError("lags need a time column")
    return Window.partitionBy(*([context.group] if context.group else [])).orderBy(*context.order())


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def _lag_downstream(out: Expanded, context: Context) -> list[str]:
    if not context.time:
        return []
    found = re.search(r"use_window_(\d+)", context.lag_policy)
    n = int(found[1]) if found else 1
    return _add(out, {f"{MARK}{c}_lagdown{n}": (F.lag(c, n).over(_window(context)), {c}) for c in _numbers(out, context)[:25]})


def _pairs(out: Expanded, context: Context, most: int) -> list[tuple[str, str]]:
    numbers = set(_numbers(out, context))
    return [(a, b) for a, b in context.interactions if a in numbers and b in numbers][:most]


def _count(name: str, usual: int, lo: int, hi: int) -> int:
    tail = re.search(r"(\d+)$", name)
    return int(tail[1]) if tail and lo <= int(tail[1]) <= hi else usual


def _engineered(out: Expanded, name: str, context: Context) -> list[str]:
    numbers = _numbers(out, context)
    if name.startswith("interactions_top") or name == "auto_l2":
        most = 10 if name == "auto_l2" else _count(name, 5, 1, 25)
        return _add(out, {f"{MARK}{a}_x_{b}": (F.col(a) * F.col(b), {a, b}) for a, b in _pairs(out, context, most)})
    if name == "ratios":
        return _add(out, {f"{MARK}{a}_div_{b}": (_ratio(a, b), {a, b}) for a, b in combinations(numbers[:6], 2)})
    if name in ("polynomial_2", "polynomial_3"):
        power, word = (2, "sq") if name[-1] == "2" else (3, "cube")
        x = {c: F.col(c).cast("double") for c in numbers}
        return _add(out, {f"{MARK}{c}_{word}": (x[c] * x[c] if power == 2 else x[c] * x[c] * x[c], {c}) for c in numbers[:6]})
    if name.startswith("lag_x_ratio"):
        k = _count(name, 1, 1, 10_000)
        pairs = _pairs(out, context, 5) or list(combinations(numbers[:6], 2))
        return _add(out, {f"{MARK}{a}_div_{b}_lag{k}": (F.lag(_ratio(a, b), k).over(_window(context)), {a, b}) for a, b in pairs[:6]})
    if re.fullmatch(r"lag_\d+", name):
        k = int(name[4:])
        return _add(out, {f"{MARK}{c}_lag{k}": (F.lag(c, k).over(_window(context)), {c}) for c in numbers[:6]})
    if name == "cyclic":
        made = {}
        for c in numbers:
            hint = next((h for h in sorted(PERIODS, key=len, reverse=True) if h in c.lower()), None)
            if hint:
                angle = F.lit(2 * math.pi) * F.col(c) / F.lit(PERIODS[hint])
                made |= {f"{MARK}{c}_sin": (F.sin(angle), {c}), f"{MARK}{c}_cos": (F.cos(angle), {c})}
        return _add(out, made)
    if name == "frequency_encoding":
        return [_frequency(out, c) for c in _words(out, context)]
    if name.startswith("binning_quantile"):
        return _binned(out, numbers[:10], _count(name, 5, 2, 20))
    if name == "target_encoding":
        return [_target_encoded(out, c, context) for c in _words(out, context)[:10]] if context.target and context.fold else []
    if name == "autoencoded":
        return _reconstruction(out, numbers[:30])
    log.warning("unknown feature group %s", name)
    return []


def _words(out: Expanded, context: Context) -> list[str]:
    return [f.name for f in out.frame.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in context.closed and not f.name.startswith(MARK)]


def _frequency(out: Expanded, c: str) -> str:
    """Dense rank of the value's count over the number of rows; null is a value. Counts are small tables, joined by size.

    Ranks are of the distinct counts, of which there are at most the square root of twice the rows.
    """
    name = f"{MARK}{c}_freq"
    counts = out.frame.groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy("__n").agg(F.count(F.lit(1)).alias("__values"))
    everything = F.sum(F.col("__n") * F.col("__values")).over(Window.partitionBy(F.lit(1))).cast("double")
    ranks = sizes.select(F.col("__n").alias("__of"), (F.dense_rank().over(Window.orderBy("__n")) / everything).alias(name))
    table = counts.join(ranks, F.col("__n") == F.col("__of")).select("__v", name)
    out.frame = out.frame.join(table, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v")
    out.lineage[name] = {c}
    return name


def _binned(out: Expanded, columns: list[str], k: int) -> list[str]:
    """Place among right-closed quantile bins, of all columns by one aggregate whose row of edges is broadcast."""
    long = out.frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("d")) for c in columns])).alias("v")).select("v.*")
    cells = long.where(F.col("d").isNotNull()).groupBy("column", "d").agg(F.count(F.lit(1)).alias("n"))
    steps = [i / k for i in range(k + 1)]
    found = quantiles(cells, "d", "n", steps, by=["column"])
    edges = found.agg(*[F.array_distinct(F.first(F.when(F.col("column") == c, F.col("quantiles")), ignorenulls=True)).alias(f"__e_{c}") for c in columns])
    made = {}
    for c in columns:
        inner = F.slice(F.col(f"__e_{c}"), F.lit(2), F.greatest(F.size(f"__e_{c}") - 2, F.lit(0)))
        made[f"{MARK}{c}_qbin{k}"] = (F.when(F.col(c).isNotNull(), F.size(F.filter(inner, _below(c)))), {c})
    out.frame = out.frame.join(F.broadcast(edges))
    names = _add(out, made)
    out.frame = out.frame.drop(*edges.columns)
    return names


def _below(column: str):
    return lambda edge: edge < F.col(column)


def _target_encoded(out: Expanded, c: str, context: Context, smoothing: float = 10.0) -> str:
    """Smoothed mean of the target over the other folds' rows of the same value."""
    name = f"{MARK}{c}_te"
    y = F.col(context.target).cast("double")
    sums = out.frame.groupBy(F.col(c).alias("__v"), F.col(context.fold).alias("__f")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    whole = Window.partitionBy("__v")
    others = lambda what: F.sum(what).over(whole) - F.col(what)
    # A row for each fold, of which one window has all.
    folds = sums.groupBy(F.col("__f").alias("__of")).agg(F.sum("__s").alias("__fs"), F.sum("__n").alias("__fn"))
    every = Window.partitionBy(F.lit(1))
    outside = lambda what: F.sum(what).over(every) - F.coalesce(F.col(what), F.lit(0))
    priors = folds.select("__of", F.try_divide(outside("__fs"), outside("__fn")).alias("__prior"))
    value = (others("__s") + smoothing * F.col("__prior")) / (others("__n") + smoothing)
    table = sums.join(F.broadcast(priors), F.col("__f").eqNullSafe(F.col("__of"))).select("__v", "__f", value.alias(name))
    out.frame = out.frame.join(table, F.col(c).eqNullSafe(F.col("__v")) & F.col(context.fold).eqNullSafe(F.col("__f")), "left").drop("__v", "__f")
    out.lineage[name] = {c}  # the target enters through other folds only
    return name


def _reconstruction(out: Expanded, columns: list[str], width: int = 8) -> list[str]:
    """A linear autoencoder: scores on the first principal components, and what they leave unexplained."""
    from tarnwell.operators.statistics import principal_components

    if len(columns) < 2:
        return []
    moments = out.frame.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = {c: (F.coalesce(F.col(c).cast("double"), F.lit(moments[f"m_{c}"] or 0.0)) - F.lit(moments[f"m_{c}"] or 0.0)) / F.lit(moments[f"s_{c}"] or 1.0) for c in columns}
    parts = principal_components(out.frame, columns, k=min(width, len(columns)), loadings=len(columns))
    sources = set(columns)
    codes = {f"{MARK}ae_z{i}": (sum((F.lit(w) * z[c] for c, w in p["loadings"]), F.lit(0.0)), sources) for i, p in enumerate(parts)}
    length = sum((z[c] * z[c] for c in columns), F.lit(0.0))
    seen = sum((code * code for code, _ in codes.values()), F.lit(0.0))
    return _add(out, {f"{MARK}ae_recon_error": (F.greatest(length - seen, F.lit(0.0)) / len(columns), sources), **codes})
