"""Equi-joins with suffixes, null-safe keys and as-of joins; plans of several joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import as_number, carried

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "asof": "asof"}


@dataclass(frozen=True)
class JoinSpec:
    left: str
    right: str
    on: tuple[str, ...]
    how: str = "inner"


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "right", null_safe: bool = True) -> DataFrame:
    """Join on same-named keys. Null keys match each other unless null_safe is off; other columns of the right side that clash get ``_<suffix>``; keys appear once."""
    kind = KINDS[how]
    taken = set(left.columns)
    renamed = {c: (f"__r_{c}" if c in on else f"{c}_{suffix}" if c in taken else c) for c in right.columns}
    other = right.select([F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    equal = [left[c].eqNullSafe(other[f"__r_{c}"]) if null_safe else left[c] == other[f"__r_{c}"] for c in on]
    joined = left.join(other, reduce(lambda a, b: a & b, equal), kind)
    merged = [F.coalesce(left[c], other[f"__r_{c}"]).alias(c) if c in on else left[c] for c in left.columns]
    return joined.select(*merged, *[other[n] for c, n in renamed.items() if c not in on])


def asof_join(left: DataFrame, right: DataFrame, time: str, by: Sequence[str] = (), suffix: str = "right", tiebreak: str | None = None, hot: bool | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time, within ``by``; null keys match each other.

    One union in time order, so no product of rows. Of right rows at one time the one of
    greatest tiebreak wins. Rows without a time are left out of the right side and match
    nothing on the left. A window over each key's rows finds the last known right row,
    or, without keys or if keys are said to be hot, windows over ranges of time, with
    what was last known carried into each later range; then no key is one task.
    """
    taken = set(left.columns)
    values = [c for c in right.columns if c != time and c not in by]
    named = {c: f"{c}_{suffix}" if c in taken else c for c in values}
    order = F.col(tiebreak) if tiebreak else F.lit(None).cast("string")
    shape = F.struct(*[F.col(c).alias(named[c]) for c in values])
    right_rows = right.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("__t"), F.lit(0).alias("__side"), order.alias("__tie"), shape.alias("__value"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("__left"))
    kind = right_rows.schema
    left_rows = left.select(*by, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind["__tie"].dataType).alias("__tie"), F.lit(None).cast(kind["__value"].dataType).alias("__value"), F.struct(*left.columns).alias("__left"))
    rows = right_rows.unionByName(left_rows)
    ordered = rows.schema["__t"].dataType.typeName() not in ("string", "binary", "boolean")
    if hot or (hot is None and not by and ordered):
        found = carried(rows, "__t", {"__found": F.col("__value")}, by, ["__side", "__tie"]).where("__side = 1")
    else:
        last = F.last("__value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = rows.withColumn("__found", last).where("__side = 1")
    value = F.when(F.col("__t").isNotNull(), F.col("__found"))
    return found.withColumn("__found", value).select("__left.*", *[F.col(f"__found.{named[c]}") for c in values])


#: Rows of the left side that a bin holds before it is split; levels of bins, each LEVEL times as wide as the one before.
BIN_ROWS, LEVEL, LEVELS = 50_000, 4, 40


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), how: str = "inner", suffix: str = "right", width: float | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows whose closed spans (start, end; numbers or times) overlap, within ``by``; with how = "left" also left rows without any.

    A point is a span whose start is its end. Spans lie in bins of a level, whose width
    suits their length, so that a span has few bins there, and in those of all wider
    levels. Two spans meet at the wider one's level, in the first bin that both have, so
    each pair comes once and no pair is made but of one bin: an equi-join on key, level and
    bin, the overlap checked in it. Bins of over bin_rows left rows are split by a hash,
    with the right rows in each part. width, of the narrowest bins, is by default such
    that the left rows would lie a few to a bin if they were spread evenly.

    Rows with a null in a span, or a start after the end, match nothing; null keys match
    each other; clashing names of the right side get ``_<suffix>``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    taken = set(left.columns) | set(by)
    named = {c: f"{c}_{suffix}" if c in taken else c for c in right.columns if c not in by}
    sides = []
    for df, span in ((left, left_span), (right, right_span)):
        start, end = (as_number(df, c).cast("double") for c in span)
        sides.append(df.select(F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}).alias("__key") if by else F.lit("").alias("__key"), start.alias("__a"), end.alias("__b"), F.struct(*df.columns).alias("__row")))
    ls, rs = sides
    if width is None:
        n, low, high = ls.agg(F.count("__a"), F.min("__a"), F.max("__b")).first()
        width = 16 * (high - low) / n if n and high > low else 1.0
    grid = lambda level: F.lit(float(width)) * F.pow(F.lit(float(LEVEL)), level)
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log(float(LEVEL), F.nullif((F.col("__b") - F.col("__a")) / float(width), F.lit(0.0))))))
    proper = [s.where(F.col("__a") <= F.col("__b")).withColumn("__own", F.coalesce(level, F.lit(0)).cast("int")) for s in (ls, rs)]
    # The levels that occur are at most LEVELS + 1 numbers.
    used = sorted({r[0] for s in proper for r in s.select("__own").distinct().collect()})
    binned = []
    for s in proper:
        levels = s.withColumn("__level", F.explode(F.filter(F.array(*[F.lit(k) for k in used]).cast("array<int>"), lambda k: k >= F.col("__own"))))
        first, last = (F.floor(F.col(c) / grid(F.col("__level"))) for c in ("__a", "__b"))
        binned.append(levels.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last))))
    keys = ["__key", "__level", "__bin"]
    # A bin has bin_rows left rows at least to be in this table.
    crowded = binned[0].groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / bin_rows).cast("int").alias("__parts")).where("__parts > 1")
    split = [b.join(crowded, keys, "left") for b in binned]
    spread = F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)).cast("long") - 1))
    a = split[0].select(*keys, spread.alias("__part"), *[F.col(c).alias(f"{c}_l") for c in ("__a", "__b", "__own", "__first", "__row")])
    b = split[1].select(*keys, copies.alias("__part"), *[F.col(c).alias(f"{c}_r") for c in ("__a", "__b", "__own", "__first", "__row")])
    once = (F.greatest("__own_l", "__own_r") == F.col("__level")) & (F.greatest("__first_l", "__first_r") == F.col("__bin"))
    pairs = a.join(b, [*keys, "__part"]).where(once & (F.col("__a_l") <= F.col("__b_r")) & (F.col("__a_r") <= F.col("__b_l")))
    found = pairs.select("__row_l.*", *[F.col(f"__row_r.{c}").alias(n) for c, n in named.items()])
    if how == "inner":
        return found
    # Equal left rows have the same pairs, so rows without any are known by their values.
    met = pairs.select(F.xxhash64("__row_l").alias("__hash"), F.col("__row_l").alias("__met")).distinct()
    every = ls.select("__row", F.xxhash64("__row").alias("__of"))
    alone = every.join(met, (F.col("__of") == F.col("__hash")) & F.col("__row").eqNullSafe(F.col("__met")), "left_anti")
    return found.unionByName(alone.select("__row.*"), allowMissingColumns=True)


def run_plan(tables: dict[str, DataFrame], plan: Sequence[JoinSpec], time: str | None = None, null_safe: bool = True) -> DataFrame:
    """Left-deep joins in the declared order, onto the first spec's left table. Without a plan, the only table."""
    if not plan:
        if len(tables) != 1:
            raise ValueError("several tables need a join plan")
        return next(iter(tables.values()))
    frame = tables[plan[0].left]
    for spec in plan:
        right = tables[spec.right]
        if spec.how == "asof":
            if time is None:
                raise ValueError("an as-of join needs a time column")
            by = [] if list(spec.on) == [time] else [c for c in spec.on if c != time]
            frame = asof_join(frame, right, time, by, spec.right)
        else:
            frame = equi_join(frame, right, spec.on, spec.how, spec.right, null_safe)
    return frame
