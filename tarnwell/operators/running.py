"""Running sums over an order without one task that has all rows.

The order's values are cut into ranges at approximate quantiles. Sums run within a
range in a window of its own; the sums of whole ranges, a few rows, run in a second
window; both are added. Equal values are in one range. Where one value may have more
rows than a range should (ties), the rows of such a value, or without one, are cut
again at quantiles of the column that they stand by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of an order, of which a task has one at a time; and bounds that are compared at once.
RANGES = 256
STEP = 16
#: Parts that the rows of a frequent value are cut into, and numbers of parts set aside for a range.
PARTS, PLACES = 256, 512
#: Bytes by which text is ordered as a number.
HEAD = 7
_RANGE, _BOUNDS, _COARSE, _FINE = "__range", "__bounds", "__coarse_bounds", "__fine_bounds"


def as_number(df: DataFrame, column: str) -> Column:
    """A column as a number in its order: times as microseconds, text by its first bytes (so that different texts may be equal)."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, HEAD)), 2 * HEAD, "0"), 16, 10).cast("long")
    if kind == "boolean":
        return F.col(column).cast("int")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column).cast("long") if kind == "date" else F.col(column)


def _in_ranges(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """df with the range that each row's place in the order is in; -1 for nulls."""
    at = as_number(df, order)
    every = F.array_distinct(F.percentile_approx(at, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges))
    bounds = df.agg(every.alias(_BOUNDS)).select(
        F.filter(_BOUNDS, lambda b, i: (i + 1) % STEP == 0).alias(_COARSE),
        F.transform(F.sequence(F.lit(0), F.coalesce(F.size(_BOUNDS), F.lit(0)).cast("int")), lambda k: F.slice(_BOUNDS, k * STEP + 1, F.lit(STEP))).alias(_FINE),
    )
    # How many bounds are below: of every STEP-th first, then of the STEP that follow.
    below = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda b: b < at)), F.lit(0))
    coarse = below(F.col(_COARSE))
    placed = df.join(F.broadcast(bounds)).withColumn("__coarse", coarse)
    return placed.withColumn(_RANGE, F.when(at.isNull(), F.lit(-1)).otherwise(F.col("__coarse") * STEP + below(F.get(_FINE, F.col("__coarse"))))).drop(_COARSE, _FINE, "__coarse")


def _in_parts(df: DataFrame, order: str, then: str, ranges: int, descending: bool) -> DataFrame:
    """df in ranges of which those of frequent values, and of nulls, are cut by the column then, at its quantiles among the value's rows.

    A value is frequent if it is two bounds at least, so there are at most half as many as ranges. The
    rows of a range that have other values are its first part; parts run with then, which always ascends.
    """
    at, second = as_number(df, order), as_number(df, then)
    edges = df.agg(F.percentile_approx(at, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges).alias(_BOUNDS))
    often = F.array_distinct(F.filter(_BOUNDS, lambda b, i: (i > 0) & (b == F.get(F.col(_BOUNDS), i - 1))))
    frequent = df.select(at.alias("__at"), second.alias("__second")).join(F.broadcast(edges.select(often.alias("__often")))).where(F.col("__at").isNull() | F.array_contains("__often", F.col("__at")))
    cut = F.percentile_approx("__second", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 10 * PARTS)
    # A row for each frequent value.
    cuts = frequent.groupBy("__at").agg(F.coalesce(F.array_distinct(cut), F.array().cast(f"array<{_kind(frequent, '__second')}>")).alias("__cuts"))
    placed = _in_ranges(df, order, ranges).join(F.broadcast(cuts), at.eqNullSafe(F.col("__at")), "left")
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < second)), F.lit(0))
    part = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(PLACES - 1 - below if descending else 1 + below)
    return placed.withColumn(_RANGE, F.col(_RANGE).cast("long") * PLACES + part).drop("__at", "__cuts")


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def running(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), then: Sequence[str] = (), descending: bool = False, ranges: int = RANGES, ties: bool = False) -> DataFrame:
    """df with columns of what stands before each row: for each name the sum of its expression over the rows of by that come first.

    order is a number or time; rows of equal order stand by the columns in then. Nulls
    of the order come first (last, if descending). Without then, equal rows stand in any order.
    ties, for which then is needed, cuts the rows of frequent values too, at the price of one more pass;
    not those of a text, as texts that begin alike are one number.
    """
    placed = _in_parts(df, order, then[0], ranges, descending) if ties and _kind(df, order) != "string" else _in_ranges(df, order, ranges)
    placed = placed.withColumns({f"__own_{n}": e for n, e in sums.items()})
    turn = F.desc if descending else F.asc
    own = {n: F.sum(f"__own_{n}") for n in sums}
    totals = placed.groupBy(*by, _RANGE).agg(*[s.alias(f"__total_{n}") for n, s in own.items()])
    earlier = Window.partitionBy(*by).orderBy(turn(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(b).alias(f"__by_{i}") for i, b in enumerate(by)], F.col(_RANGE).alias("__of"), *[F.coalesce(F.sum(f"__total_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy(*by, _RANGE).orderBy(turn(order), *then).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__own_{n}").over(inside), F.lit(0)) for n in sums})
    same = F.col(_RANGE) == F.col("__of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{i}"))
    # Without by there is a row for each range, or part of one, at most.
    joined = local.join(before if by else F.broadcast(before), same)
    return joined.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums])


def carried(df: DataFrame, order: str, values: dict[str, Column], by: Sequence[str] = (), then: Sequence[str] = (), ranges: int = RANGES, current: bool = True) -> DataFrame:
    """df with columns of what was last known: for each name its expression's last value that is not null, of the rows of by that come first and, if current, of the row itself.

    As in running, rows stand by order and then by the columns in then, nulls first. A
    range's own last value is carried over all ranges that follow without one.
    """
    placed = _in_ranges(df, order, ranges).withColumns({f"__own_{n}": e for n, e in values.items()})
    latest = {n: F.max(F.when(F.col(f"__own_{n}").isNotNull(), F.struct(F.col(order).alias("at"), *[F.col(c).alias(f"then_{i}") for i, c in enumerate(then)], F.col(f"__own_{n}").alias("value")))) for n in values}
    ends = placed.groupBy(*by, _RANGE).agg(*[e.alias(f"__end_{n}") for n, e in latest.items()])
    # A row for each range of a group.
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(b).alias(f"__by_{i}") for i, b in enumerate(by)], F.col(_RANGE).alias("__of"), *[F.last(f"__end_{n}.value", ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in values])
    inside = Window.partitionBy(*by, _RANGE).orderBy(order, *then).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    local = placed.withColumns({f"__in_{n}": F.last(f"__own_{n}", ignorenulls=True).over(inside) for n in values})
    same = F.col(_RANGE) == F.col("__of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{i}"))
    joined = local.join(before if by else F.broadcast(before), same)
    return joined.select(*df.columns, *[F.coalesce(f"__in_{n}", f"__before_{n}").alias(n) for n in values])


def ranked(df: DataFrame, order: str, then: Sequence[str] = (), by: Sequence[str] = (), descending: bool = False, name: str = "place", ties: bool = False) -> DataFrame:
    """df with each row's place from 0; ties as in running."""
    return running(df, order, {name: F.lit(1).cast("long")}, by=by, then=then, descending=descending, ties=ties)


def quantiles(cells: DataFrame, value: str, n: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by columns and quantiles: exact, interpolated between the neighbouring rows, of values that stand n times each."""
    known = cells.where(F.col(value).isNotNull())
    placed = running(known, value, {"__first": F.col(n)}, by=by)
    total = known.groupBy(*[F.col(b).alias(f"__of_{i}") for i, b in enumerate(by)]).agg(F.sum(n).alias("__n"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__of_{i}"))
    both = placed.join(F.broadcast(total), same)  # a row for each group of by
    low = [F.floor(F.lit(q) * (F.col("__n") - 1)) for q in at]
    high = [F.ceil(F.lit(q) * (F.col("__n") - 1)) for q in at]
    covers = lambda place: (F.col("__first") <= place) & (place < F.col("__first") + F.col(n))
    picked = [F.max(F.when(covers(p), F.col(value))) for pair in zip(low, high, strict=True) for p in pair]
    one = both.groupBy(*by).agg(F.max("__n").alias("__n"), *[p.cast("double").alias(f"__p{i}") for i, p in enumerate(picked)])
    share = [F.lit(q) * (F.col("__n") - 1) - F.floor(F.lit(q) * (F.col("__n") - 1)) for q in at]
    found = [F.col(f"__p{2 * i}") + s * (F.col(f"__p{2 * i + 1}") - F.col(f"__p{2 * i}")) for i, s in enumerate(share)]
    return one.select(*by, F.array(*found).alias("quantiles"))


def counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct combination of the columns with its number of rows n."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
