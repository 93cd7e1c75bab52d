"""Column profiles, semantic types, likely roles and join proposals."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import quantiles

#: Name hints and identifier words (fixed values).
TIME_HINTS = ("time", "ts", "date", "datetime", "timestamp", "created_at", "event_at", "_dt")
TARGET_HINTS = ("target", "label", "y", "defect", "fail", "outcome", "yield", "demand", "sales", "is_", "_flag")
ID_WORDS = frozenset({"id", "uuid", "key", "code", "serial", "idx", "index", "lot", "batch", "sku", "hash", "token"})
ID_PATTERNS = (r"_run_idx$", r"^.*_[0-9]{6,}$")
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def words_of(name: str) -> list[str]:
    """A column name's words, cut at underscores, hyphens, spaces and lower-to-upper changes."""
    cut = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [w for w in re.split(r"[_\s-]+", cut.lower()) if w]


def looks_like_id(name: str) -> bool:
    return bool(ID_WORDS.intersection(words_of(name))) or any(re.search(p, name, re.I) for p in ID_PATTERNS)


def hinted(name: str, hints: tuple[str, ...]) -> bool:
    return any(h in name.lower() for h in hints)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in order; booleans and times are none."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def known(df: DataFrame, column: str) -> Column:
    """A column with NaN as null, for one notion of missing."""
    c = F.col(f"`{column}`")
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def _cells(df: DataFrame) -> DataFrame:
    """column, d (of numbers), key (exact form of a known value) and n, of every distinct value: columns are unpivoted before they are counted, in one shuffle."""
    values = []
    for f in df.schema.fields:
        c = known(df, f.name)
        number = is_numeric(f.dataType)
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        text = None if whole or isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.to_json(c) if nested else c.cast("string")
        value = {"column": F.lit(f.name), "d": c.cast("double") if number else None, "l": c.cast("long") if whole else None, "s": text}
        kinds = {"column": "string", "d": "double", "l": "long", "s": "string"}
        values.append(F.struct(*[(F.lit(None) if v is None else v).cast(kinds[k]).alias(k) for k, v in value.items()]))
    return df.select(F.explode(F.array(*values)).alias("v")).select("v.*").groupBy("column", "d", "l", "s").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: n_total, n_missing, n_unique, semantic, and of numbers and times min, max (times as seconds), mean, stdev and the quantiles.

    Counts and moments are one aggregate. Distinct values and quantiles are exact, from
    counts of values and their running sums, so no task has all values of a column;
    approximate takes sketches instead, in the same pass, for columns with as many values as rows.
    """
    parts = []
    for f in df.schema.fields:
        c = known(df, f.name)
        number = is_numeric(f.dataType)
        clock = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        value = c.cast("double") if number else F.lit(None).cast("double")
        bound = c.cast("timestamp").cast("double") if clock else value
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        sketched = [] if not approximate else [
            F.approx_count_distinct(F.to_json(c) if nested else c, 0.01).alias("n_unique"),
            (F.percentile_approx(value, F.array(*map(F.lit, QUANTILES)), 10_000) if number else F.lit(None).cast("array<double>")).alias("quantiles"),
        ]
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.count(F.lit(1)).alias("n_total"),
                F.count_if(c.isNull()).alias("n_missing"),
                F.min(bound).alias("min"),
                F.max(bound).alias("max"),
                F.avg(value).alias("mean"),
                (F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, F.lit(0.0)))).alias("stdev"),
                *sketched,
                F.lit(_fixed_semantic(f.dataType)).alias("fixed"),
            ).alias(f"c{len(parts)}")
        )
    one = df.agg(*parts)
    rows = one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
    if not approximate:
        cells = _cells(df)
        unique = cells.groupBy("column").agg(F.count_if(F.coalesce(F.col("d").cast("string"), F.col("s")).isNotNull()).alias("n_unique"))
        rows = rows.join(F.broadcast(unique.select(F.col("column").alias("of"), F.col("n_unique").alias("known"))), F.col("column") == F.col("of"), "left")
        rows = rows.withColumn("n_unique", F.coalesce("known", F.lit(0).cast("long"))).drop("of", "known")
        if numeric_columns(df):
            # Rows of one column each.
            found = quantiles(cells.where("d is not null"), "d", "n", QUANTILES, by=["column"]).withColumnRenamed("column", "of")
            rows = rows.join(F.broadcast(found), F.col("column") == F.col("of"), "left").drop("of")
        else:
            rows = rows.withColumn("quantiles", F.lit(None).cast("array<double>"))
    text_from = F.greatest(F.lit(50), F.floor(F.sqrt(F.col("n_total"))))
    rows = rows.withColumn("semantic", F.coalesce("fixed", F.when(F.col("n_unique") <= text_from, F.lit("categorical")).otherwise(F.lit("text"))))
    return rows.select("column", "n_total", "n_missing", "n_unique", "min", "max", "mean", "stdev", "quantiles", "semantic")


def _fixed_semantic(kind: T.DataType) -> str | None:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if is_numeric(kind):
        return "numeric"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None


def approx_distinct(df: DataFrame, columns: list[str], precision: int = 12) -> DataFrame:
    """column and n_unique by HyperLogLog of the string form; its state is bounded, for tables of any size."""
    one = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), precision)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_unique")) for c in columns])).alias("r")).select("r.*")


def top_values(df: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """The k most frequent values of each column: column, value, n, place; ties by value. One pass: values are unpivoted before they are counted."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def looks_like_time(df: DataFrame, column: str) -> bool:
    """Whether more than nine tenths of the first 20 values parse as times."""
    head = df.select(F.col(f"`{column}`").cast("string").alias("v")).where("v is not null").limit(20)
    n, ok = head.agg(F.count("v"), F.count(F.expr("try_to_timestamp(v)"))).first()
    return bool(n) and ok > 0.9 * n


#: What a profile's row must be like for a role.
ROLES = {
    "time": lambda row: row["semantic"] == "datetime" or (hinted(row["column"], TIME_HINTS) and bool(row.get("parses_as_time"))),
    "target": lambda row: hinted(row["column"], TARGET_HINTS),
    "id": lambda row: looks_like_id(row["column"]) and row["n_unique"] >= max(1, int(0.95 * row["n_total"])),
}


def likely_roles(profile: list[dict]) -> dict[str, list[str]]:
    """The columns of a profile that each role's test passes; an id has a name like one and nearly one value per row."""
    return {role: [row["column"] for row in profile if test(row)] for role, test in ROLES.items()}


def propose_joins(columns: dict[str, list[str]]) -> list[dict]:
    """For each pair of tables that share key-like or time-like names: an inner join on them, in the left table's order."""
    holders: dict[str, list[str]] = {}
    for table, names in sorted(columns.items()):
        for name in dict.fromkeys(names):
            if looks_like_id(name) or hinted(name, TIME_HINTS):
                holders.setdefault(name, []).append(table)
    shared: dict[tuple[str, str], list[str]] = {}
    for name, tables in holders.items():
        for pair in combinations(tables, 2):
            shared.setdefault(pair, []).append(name)
    return [{"left": a, "right": b, "on": sorted(names, key=columns[a].index), "how": "inner"} for (a, b), names in sorted(shared.items())]


def inspect_tables(tables: dict[str, DataFrame]) -> dict:
    """Profiles, roles and proposed joins of all tables; a table that fails is listed with its error."""
    report: dict = {"tables": {}, "errors": {}, "joins": []}
    for name, df in sorted(tables.items()):
        try:
            rows = [r.asDict(recursive=True) for r in column_profile(df).collect()]
            for row in rows:
                if row["semantic"] in ("categorical", "text") and hinted(row["column"], TIME_HINTS):
                    row["parses_as_time"] = looks_like_time(df, row["column"])
            report["tables"][name] = {"columns": rows, "roles": likely_roles(rows)}
        except Exception as error:  # a bad file must not end the report
            report["errors"][name] = str(error)[:500]
    report["joins"] = propose_joins({n: [c["column"] for c in t["columns"]] for n, t in report["tables"].items()})
    return report


def within_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """n_rows, n_below and n_above of each bounded column: declared hard bounds as a data-quality report."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c) < F.lit(lo)).alias("n_below"), F.count_if(F.col(c) > F.lit(hi)).alias("n_above")).alias(f"b{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())]
    one = df.agg(*parts)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
