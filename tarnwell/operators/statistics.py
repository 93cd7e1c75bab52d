"""Correlations, principal components, mutual information, partial dependence and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.sources.saved import Saved

from .running import ranked, running


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows where both are known; null for a constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_a, col_b and corr of all pairs, in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """On the driver; its size is the number of columns squared. Unknown correlations count as 0."""
    matrix = np.eye(len(columns))
    for row in correlation_pairs(df, columns).collect() if len(columns) > 1 else ():
        i, j = columns.index(row["col_a"]), columns.index(row["col_b"])
        matrix[i, j] = matrix[j, i] = row["corr"] or 0.0
    return matrix


def principal_components(df: DataFrame, columns: list[str], k: int = 20, loadings: int = 8) -> list[dict]:
    """Components of the standardised columns from their correlation matrix; each one's largest loading is positive."""
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    found = []
    for i in np.argsort(-values, kind="stable")[: min(k, len(columns))]:
        vector = vectors[:, i] * (np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i]) or 1)
        top = sorted(zip(columns, vector.tolist(), strict=True), key=lambda p: (-abs(p[1]), p[0]))[:loadings]
        found.append({"explained": max(0.0, float(values[i])) / max(1e-12, float(values.sum())), "loadings": top})
    return found


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins of a number with a target's values, in nats."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # One row of bounds is broadcast; Spark knows it is a single row.
    binned = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).join(F.broadcast(bounds)).select(F.least(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)), F.lit(bins - 1)).alias("x"), F.col(target).alias("y"))
    cells = binned.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    sums = cells.withColumns({"nx": F.sum("n").over(Window.partitionBy("x")), "ny": F.sum("n").over(Window.partitionBy("y")), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    p = F.col("n") / F.col("total")
    return sums.agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mutual_info"))


def _digamma(x: Column) -> Column:
    """By the recurrence up to x + 6 and the asymptotic series there; good to 1e-10 from 1 on."""
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def _counted_below(values: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (id, q, with_equal) with below, how many of values (v) are less than q, or equal to it if with_equal; by running sums over ranges."""
    none = F.lit(None).cast("long")
    # At equal values: queries for less, values, queries for less or equal.
    points = values.select(F.col("v"), F.lit(1).alias("turn"), none.alias("id"), F.lit(False).alias("with_equal"))
    asked = queries.select(F.col("q").alias("v"), F.when(F.col("with_equal"), 2).otherwise(0).alias("turn"), "id", "with_equal")
    both = points.unionByName(asked)
    return running(both, "v", {"below": F.when(F.col("turn") == 1, 1).otherwise(0).cast("long")}, then=["turn"]).where("turn <> 1").select("id", "with_equal", "below")


def _information(n: int, own: float | None, of: float | None, nearer: float | None) -> float:
    if not n:
        return 0.0
    harmonic = math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) if n > 50 else sum(1 / i for i in range(1, n)) - 0.5772156649015329
    return max(0.0, harmonic + own - of - nearer)


def neighbour_information(df: DataFrame, column: str, target: str, neighbours: int = 3, block: int = 4096) -> float:
    """Mutual information of a number with a target's values, in nats, from nearest neighbours (Ross 2014); at least 0.

    For each row the distance to its neighbours-th nearest row of the same value, and how
    many rows of all lie nearer than that. Rows of a value stand in order in blocks with
    the next ones' edges, so distances need windows of a block; rows that lie nearer are
    running counts over ranges. Rows whose value no other row has are left out, as are
    rows with a null. Where so many rows are equal that the distance is 0, the equal ones
    count.
    """
    rows = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).select(F.col(column).cast("double").alias("v"), F.col(target).alias("y"))
    sizes = rows.groupBy(F.col("y").alias("of")).agg(F.count(F.lit(1)).alias("of_n")).where("of_n > 1")
    with Saved(df.sparkSession) as saved:
        # Places within a value, which with it name a row.
        placed = saved(ranked(rows.join(sizes, F.col("y") == F.col("of")).select("v", "y", "of_n"), "v", by=["y"]).withColumn("k", F.least(F.lit(neighbours), F.col("of_n") - 1).cast("int")))
        at = F.floor(F.col("place") / block)
        edge = lambda shift: F.floor((F.col("place") + shift) / block)
        blocks = placed.withColumn("block", F.explode(F.array_distinct(F.array(at, edge(neighbours), edge(-neighbours)))))
        inside = Window.partitionBy("y", "block").orderBy("place")
        beside = [f(F.col("v"), i).over(inside) for i in range(1, neighbours + 1) for f in (F.lag, F.lead)]
        near = F.array_sort(F.filter(F.array(*[F.struct(F.abs(b - F.col("v")).alias("gap"), b.alias("v")) for b in beside]), lambda s: s["gap"].isNotNull()))
        found = blocks.withColumn("far", F.get(near, F.col("k") - 1)).where(at == F.col("block"))
        # The farthest neighbour's own value bounds its side exactly.
        high = F.when(F.col("far.v") >= F.col("v"), F.col("far.v")).otherwise(F.col("v") + F.col("far.gap"))
        low = F.when(F.col("far.v") <= F.col("v"), F.col("far.v")).otherwise(F.col("v") - F.col("far.gap"))
        spans = saved(found.select(F.monotonically_increasing_id().alias("id"), "of_n", "k", "v", low.alias("low"), high.alias("high"), (F.col("far.gap") == 0).alias("equal")))
        # Above 0 the ends are open: less than high, without those up to low. At 0 they are closed.
        asked = spans.select("id", F.explode(F.array(F.struct(F.col("high").alias("q"), F.col("equal").alias("with_equal"), F.lit(1).alias("sign")), F.struct(F.col("low").alias("q"), (~F.col("equal")).alias("with_equal"), F.lit(-1).alias("sign")))).alias("a")).select("id", "a.*")
        ends = _counted_below(spans.select("v"), asked.select((F.col("id") * 2 + (F.col("sign") > 0).cast("int")).alias("id"), "q", "with_equal"))
        nearer = ends.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(F.sum(F.when(F.col("id") % 2 == 1, F.col("below")).otherwise(-F.col("below"))).alias("m"))
        means = spans.join(nearer, "id").agg(F.count(F.lit(1)).alias("n"), F.avg(_digamma(F.col("k").cast("double"))), F.avg(_digamma(F.col("of_n").cast("double"))), F.avg(_digamma(F.greatest(F.col("m"), F.lit(1)).cast("double")))).first()
    return _information(*means)


def shortlist(df: DataFrame, columns: Sequence[str], target: str, most: int, bins: int = 16) -> list[str]:
    """The columns that tell most of a target, at most so many; of a number's target its quantile bins."""
    if len(columns) <= most:
        return list(columns)
    if isinstance(df.schema[target].dataType, T.NumericType):
        cuts = [c for c in df.agg(F.percentile_approx(target, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10_000)).first()[0] or []]
        df = df.withColumn("__bin", F.when(F.col(target).isNotNull(), sum(((F.col(target) > c).cast("int") for c in dict.fromkeys(cuts)), F.lit(0))))
        target = "__bin"
    told = {c: neighbour_information(df, c, target) for c in columns}
    return sorted(columns, key=lambda c: (-told[c], c))[:most]


def partial_correlation(matrix: np.ndarray, a: int, b: int, given: tuple[int, ...]) -> float:
    """From the inverse of the correlation matrix of the columns concerned."""
    at = [a, b, *given]
    inverse = np.linalg.pinv(matrix[np.ix_(at, at)])
    return float(np.clip(-inverse[0, 1] / math.sqrt(max(1e-300, inverse[0, 0] * inverse[1, 1])), -1, 1))


def fisher_p(r: float, n: int, given: int) -> float:
    """Two-sided p-value of a (partial) correlation by Fisher's z."""
    if n - given - 3 <= 0:
        return 1.0
    r = min(max(r, -0.999999), 0.999999)
    return math.erfc(abs(math.atanh(r)) * math.sqrt(n - given - 3) / math.sqrt(2))


def dependence_graph(df: DataFrame, columns: list[str], alpha: float = 0.05, max_columns: int = 20, max_given: int = 2) -> list[dict]:
    """A skeleton over the most varying columns: an edge goes if some set of one or two other columns makes its ends independent; unshielded colliders are oriented.

    One aggregate for variances and one for correlations; the search works on the small matrix.
    """
    spread = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    columns = sorted(sorted(columns, key=lambda c: (-(spread[c] or 0.0), c))[:max_columns], key=columns.index)
    rows = df.select(columns).dropna()
    n, matrix = rows.count(), correlation_matrix(rows, columns)
    d = range(len(columns))
    edges, apart = {}, {}
    for a, b in combinations(d, 2):
        edges[a, b] = (matrix[a, b], fisher_p(matrix[a, b], n, 0))
        for size in range(1, max_given + 1):
            for given in combinations([c for c in d if c not in (a, b)], size):
                r = partial_correlation(matrix, a, b, given)
                if (a, b) in edges and fisher_p(r, n, size) > alpha:
                    del edges[a, b]
                    apart[a, b] = set(given)
    directed = {}
    for (a, b), given in apart.items():
        for c in d:
            if c not in (a, b) and tuple(sorted((a, c))) in edges and tuple(sorted((b, c))) in edges and c not in given:
                directed[tuple(sorted((a, c)))], directed[tuple(sorted((b, c)))] = c, c
    out = []
    for (a, b), (r, p) in edges.items():
        src, dst = (a, b) if directed.get((a, b), b) == b else (b, a)
        out.append({"src": columns[src], "dst": columns[dst], "kind": "directed" if (a, b) in directed else "undirected", "p": p, "weight": abs(float(r))})
    return out


def ks_statistic(df: DataFrame, value: str, side: Column) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic: the largest gap between cumulative shares.

    Counts per distinct value are aggregated first, and their running sums go by ranges of values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    sums = running(counts, "v", {"below_a": F.col("a"), "below_b": F.col("b")})
    total = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.try_divide(F.col("below_a") + F.col("a"), F.col("all_a")) - F.try_divide(F.col("below_b") + F.col("b"), F.col("all_b")))
    return sums.join(F.broadcast(total)).agg(F.max(gap).alias("ks"))


def ks_p(statistic: float, n: int, m: int) -> float:
    """Asymptotic p-value; 1 for fewer than five rows on a side."""
    if min(n, m) < 5:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * statistic
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 1e-9 else 1.0


def f_test_p(var_a: float, n: int, var_b: float, m: int) -> float:
    """Two-sided F test of equal variances; 1 where it cannot be made."""
    if min(n, m) < 5 or not var_a or not var_b:
        return 1.0
    x, d1, d2 = var_a / var_b, n - 1, m - 1
    below = _beta_inc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))
    return min(1.0, 2 * min(below, 1 - below))


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by numerical integration of a smooth substitution."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    # t = sin^2(u) removes the end points' poles for a, b >= 1/2.
    u = np.linspace(0, math.asin(math.sqrt(x)), 20_001)
    with np.errstate(divide="ignore"):
        f = 2 * np.exp((2 * a - 1) * np.log(np.maximum(np.sin(u), 1e-300)) + (2 * b - 1) * np.log(np.cos(u)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return float(min(1.0, np.trapezoid(f, u)))
