"""Profiles that can be added up: a row for each part of a table and column, with sketches as binary columns.

New files get rows of their own; the profile of all is merged from the rows, and no old
file is read again. Merged rows are summaries too, so they can be merged in any tree.
Distinct values are a HyperLogLog sketch (merged registers are the same whatever the
parts are; a sketch that was never merged estimates a little better), quantiles a KLL
sketch, whose ranks err by about 1.3 % at K; counts and moments are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import QUANTILES, is_numeric, known

#: Binary logarithm of HyperLogLog's registers (relative error 0.8 %), and KLL's k.
REGISTERS, K = 14, 200
_ROW = ("n", "missing", "low", "high", "mean", "squares", "distinct", "ranks")


def summaries(df: DataFrame, parts: dict[str, Column] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """parts, column, n, missing, low, high, mean, squares (of distances from the mean), distinct and ranks, in one pass over df.

    NaN is missing; times count as seconds, and have low and high only, as texts have neither.
    """
    cells = []
    for f in df.schema.fields:
        if f.name in (columns or df.columns) and f.name not in (parts or {}):
            c = known(df, f.name)
            clock = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
            nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            number = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
            bound = c.cast("timestamp").cast("double") if clock else number
            exact = F.to_json(c) if nested else c.cast("string")
            ranks = F.kll_sketch_agg_double(number, F.lit(K)) if is_numeric(f.dataType) else F.lit(None).cast("binary")
            made = (F.count(F.lit(1)), F.count_if(c.isNull()), F.min(bound), F.max(bound), F.avg(number), F.var_pop(number) * F.count(number), F.hll_sketch_agg(exact, REGISTERS), ranks)
            cells.append(F.struct(F.lit(f.name).alias("column"), *[m.alias(n) for m, n in zip(made, _ROW, strict=True)]).alias(f"__{len(cells)}"))
    by = [e.alias(n) for n, e in (parts or {}).items()]
    one = (df.groupBy(*by) if by else df).agg(*cells)
    return one.select(*(parts or {}), F.explode(F.array(*[f"__{i}" for i in range(len(cells))])).alias("r")).select(*(parts or {}), "r.*")


def merged(rows: DataFrame) -> DataFrame:
    """A summary of each column from those of its parts."""
    n = F.col("n") - F.col("missing")
    middle = rows.groupBy(F.col("column").alias("of")).agg((F.sum(n * F.col("mean")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), n)), F.lit(0))).alias("middle"))
    apart = F.col("squares") + n * (F.col("mean") - F.col("middle")) ** 2
    back = rows.join(F.broadcast(middle), F.col("column") == F.col("of"))  # a row for each column
    return back.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("middle").alias("mean"),
        F.sum(apart).alias("squares"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def answers(rows: DataFrame, at: Sequence[float] = QUANTILES) -> DataFrame:
    """column, n_total, n_missing, n_unique, min, max, mean, stdev and quantiles, as column_profile has them."""
    n = F.col("n") - F.col("missing")
    stdev = F.when(n == 1, F.lit(0.0)).otherwise(F.sqrt(F.col("squares") / F.nullif(n - 1, F.lit(0))))
    ranked = F.col("mean").isNotNull()
    # Only sketches that hold values are asked; an empty one has no quantiles.
    sketch = F.when(ranked, F.col("ranks"))
    quantiles = F.when(ranked, F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in at]))
    return merged(rows).select("column", F.col("n").alias("n_total"), F.col("missing").alias("n_missing"), F.hll_sketch_estimate("distinct").alias("n_unique"), F.col("low").alias("min"), F.col("high").alias("max"), "mean", F.when(ranked, stdev).alias("stdev"), quantiles.alias("quantiles"))
