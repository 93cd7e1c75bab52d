"""The queries of the analytic operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import scalars as S
from tarnwell.control import models
from tarnwell.operators import clusters, joins, metrics, profile, sampling, sensors, series, statistics, summaries, vectors
from tarnwell.plans.features import Context, expand
from tarnwell.sources import tables
from tarnwell.sources.tables import latest_wins
from tarnwell.streaming import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def r(column, digits: int = 6):
    """Rounded, so that the order of floating-point sums does not show. Adding 0 makes -0 a 0."""
    return F.round(column, digits) + F.lit(0.0)


# --- scans, joins -----------------------------------------------------------------


@query("scan_filter_project", "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity >= 25")
def _(spark, d):
    li = _t(spark, d, "lineitem").where((F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'")) & (F.col("l_quantity") >= 25))
    return li.select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def _customer_orders(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("value"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return c, o


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(
        f"join_{_how}",
        f"""SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey, c.c_mktsegment, c.c_acctbal AS value, o.o_orderkey, o.o_totalprice AS value_orders
FROM customer c {_sql} orders o ON c.c_custkey = o.o_custkey""",
    )(lambda spark, d, how=_how: joins.equi_join(*_customer_orders(spark, d), ["c_custkey"], how, "orders"))


@query("join_null_safe", "SELECT s.k, s.n AS n, c.n AS n_c FROM (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1) c ON s.k IS NOT DISTINCT FROM c.k WHERE s.n IS NOT NULL")
def _(spark, d):
    s = _t(spark, d, "supplier").groupBy(F.expr("nullif(s_nationkey, 3)").alias("k")).agg(F.count("*").alias("n"))
    c = _t(spark, d, "customer").groupBy(F.expr("nullif(c_nationkey, 3)").alias("k")).agg(F.count("*").alias("n"))
    return joins.equi_join(s, c, ["k"], "left", "c")


@query(
    "join_multi_plan",
    """SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(spark, d):
    tables = {
        "lineitem": _t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"),
        "orders": _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey")),
        "customer": _t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")),
        "nation": _t(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", F.col("n_regionkey").alias("regionkey")),
        "region": _t(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"),
    }
    plan = [joins.JoinSpec("lineitem", "orders", ("l_orderkey",)), joins.JoinSpec("lineitem", "customer", ("custkey",)), joins.JoinSpec("lineitem", "nation", ("nationkey",)), joins.JoinSpec("lineitem", "region", ("regionkey",))]
    wide = joins.run_plan(tables, plan, null_safe=False)
    return wide.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


for _how, _word in (("left_semi", ""), ("left_anti", "NOT ")):
    query(f"join_{_how}", f"SELECT c_custkey, c_name FROM customer WHERE {_word}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")(
        lambda spark, d, how=_how: _t(spark, d, "customer").select("c_custkey", "c_name").join(_t(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", how)
    )


@query(
    "asof_backward",
    """SELECT l.event_id, l.user_id, l.ts, r.value AS value_p FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) l
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = (SELECT max(event_type) FROM events)) r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def _(spark, d):
    e = _t(spark, d, "events")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(kinds))
    left = e.where("event_type = lo").select("event_id", "user_id", "ts")
    right = e.where("event_type = hi").select("user_id", "ts", F.col("value").alias("value_p"))
    return joins.asof_join(left, right, "ts", ["user_id"], "p")


@query(
    "asof_no_key",
    """SELECT l.event_id, l.ts, r.value AS value_p FROM (SELECT event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) l
ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ts) r ON l.ts >= r.ts""",
)
def _(spark, d):
    e = _t(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))))
    left = e.where("event_type = lo").select("event_id", "ts")
    return joins.asof_join(left, e.where("event_type = hi").select("ts", F.col("value").alias("value_p")), "ts", tiebreak="value_p")


@query(
    "join_interval",
    """WITH s AS (SELECT user_id, event_type AS kind, date_trunc('week', ts) AS week, min(ts) AS began, max(ts) AS ended FROM events GROUP BY ALL)
SELECT e.event_id, e.user_id, e.ts, s.kind, s.began, s.ended FROM events e JOIN s ON s.user_id = e.user_id AND e.ts BETWEEN s.began AND s.ended""",
)
def _(spark, d):
    e = _t(spark, d, "events")
    spans = e.groupBy("user_id", F.col("event_type").alias("kind"), F.date_trunc("week", "ts")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return joins.interval_join(e.select("event_id", "user_id", "ts"), spans.select("user_id", "kind", "began", "ended"), ("ts", "ts"), ("began", "ended"), ["user_id"])


# --- profiles and statistics ----------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILE_SQL = "SELECT '{c}' AS \"column\", count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS stdev, round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lineitem"


@query("profile_numeric", " UNION ALL ".join(_PROFILE_SQL.format(c=c) for c in _NUM))
def _(spark, d):
    p = profile.column_profile(_t(spark, d, "lineitem").select(_NUM))
    q = lambda i, n: r(F.element_at("quantiles", i)).alias(n)
    return p.select("column", "n_total", "n_missing", "n_unique", "min", "max", r(F.col("mean"), 8).alias("mean"), r(F.col("stdev")).alias("stdev"), q(1, "p01"), q(4, "p50"), q(7, "p99"))


def profile_joined(spark, d):
    """The minimum slice: scan, join and profile of the joined frame."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), *_NUM)
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice", "o_orderpriority")
    p = profile.column_profile(joins.equi_join(li, o, ["orderkey"], "inner", "orders", null_safe=False))
    return p.select("column", "semantic", "n_total", "n_missing", "n_unique", r(F.col("mean"), 8).alias("mean"))


query(
    "profile_joined",
    "WITH j AS (SELECT l_orderkey AS orderkey, l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'categorical' if c == 'o_orderpriority' else 'numeric'}' AS semantic, count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, {'NULL::DOUBLE' if c == 'o_orderpriority' else f'round(avg({c}), 8)'} AS mean FROM j"
        for c in ["orderkey", *_NUM, "o_totalprice", "o_orderpriority"]
    ),
)(profile_joined)


@query(
    "profile_merged",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_total, count(*) - count({c}) AS n_missing, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS stdev, true AS n_unique_near, true AS median_near FROM lineitem" for c in _NUM),
)
def _(spark, d):
    """Summaries of each month's rows, merged, beside exact answers."""
    li = _t(spark, d, "lineitem")
    parts = summaries.summaries(li, {"month": F.date_trunc("month", "l_shipdate")}, _NUM)
    found = summaries.answers(parts, [0.5])
    exact = li.agg(*[F.array(F.count_distinct(c).cast("double"), F.percentile(c, 0.44), F.percentile(c, 0.56)).alias(c) for c in _NUM])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("e")) for c in _NUM])).alias("x")).select("x.*")
    median = F.col("quantiles")[0]
    rows = found.join(F.broadcast(exact), F.col("column") == F.col("of"))
    return rows.select("column", "n_total", "n_missing", "min", "max", r(F.col("mean"), 8).alias("mean"), r(F.col("stdev")).alias("stdev"), (F.abs(F.col("n_unique") - F.col("e")[0]) <= F.greatest(F.lit(1.0), 0.04 * F.col("e")[0])).alias("n_unique_near"), median.between(F.col("e")[1], F.col("e")[2]).alias("median_near"))


@query("dtype_classify", "SELECT 'c_name' AS \"column\", CASE WHEN count(DISTINCT c_name) <= greatest(50, floor(sqrt(count(*)))) THEN 'categorical' ELSE 'text' END AS semantic FROM customer UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) <= greatest(50, floor(sqrt(count(*)))) THEN 'categorical' ELSE 'text' END FROM customer UNION ALL SELECT 'c_acctbal', 'numeric'")
def _(spark, d):
    return profile.column_profile(_t(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal")).select("column", "semantic")


@query("missingness", "SELECT 'value' AS \"column\", count(*) AS n_total, count(*) FILTER (WHERE event_id % 7 = 0) AS n_missing FROM events UNION ALL SELECT 'event_type', count(*), count(*) FILTER (WHERE event_id % 5 = 0) FROM events")
def _(spark, d):
    e = _t(spark, d, "events").select(F.expr("if(event_id % 7 = 0, double('NaN'), value)").alias("value"), F.expr("if(event_id % 5 = 0, null, event_type)").alias("event_type"))
    return profile.column_profile(e).select("column", "n_total", "n_missing")


@query("distinct_exact", "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM events")
def _(spark, d):
    return _t(spark, d, "events").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_type").alias("n_types"))


@query("distinct_hll")
def _(spark, d):
    return profile.approx_distinct(_t(spark, d, "events"), ["user_id", "event_type"])


@query("top_categories", "WITH v AS (SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders), c AS (SELECT \"column\", value, count(*) AS n FROM v GROUP BY 1, 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS place FROM c) SELECT * FROM p WHERE place <= 3")
def _(spark, d):
    return profile.top_values(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 3)


@query("bounds_check", "SELECT 'l_quantity' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE l_quantity < 2) AS n_below, count(*) FILTER (WHERE l_quantity > 48) AS n_above FROM lineitem UNION ALL SELECT 'l_discount', count(*), count(*) FILTER (WHERE l_discount < 0.02), count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem")
def _(spark, d):
    return profile.within_bounds(_t(spark, d, "lineitem"), {"l_quantity": (2, 48), "l_discount": (0.02, 0.08)})


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in _PAIRS))
def _(spark, d):
    return statistics.correlation_pairs(_t(spark, d, "lineitem"), _NUM).select("col_a", "col_b", r(F.col("corr")).alias("corr"))


@query(
    "mutual_info_binned",
    """WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10.0::DOUBLE AS w FROM lineitem), x AS (SELECT least(floor((l_quantity - lo) / w), 9) AS x, l_returnflag AS y FROM lineitem, b),
c AS (SELECT x, y, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
SELECT round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nx * ny))), 8) AS mutual_info FROM s""",
)
def _(spark, d):
    return statistics.mutual_information(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag").select(r(F.col("mutual_info"), 8).alias("mutual_info"))


_PSI = "(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * ({x} + 6) ** 2) + 1 / (120 * ({x} + 6) ** 4) - 1 / (252 * ({x} + 6) ** 6) + 1 / (240 * ({x} + 6) ** 8)" + "".join(f" - 1 / ({{x}} + {i})" for i in range(6)) + ")"


@query(
    "mutual_info_neighbours",
    f"""WITH e AS (SELECT value AS v, event_type AS y, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
b AS (SELECT v, y, c, [{", ".join(f"lag(v, {i}) OVER w, lead(v, {i}) OVER w" for i in (1, 2, 3))}] AS b FROM e WHERE c > 1 WINDOW w AS (PARTITION BY y ORDER BY v)),
f AS (SELECT row_number() OVER () AS i, v, y, c, least(3, c - 1) AS k, list_sort(list_transform(list_filter(b, lambda x: x IS NOT NULL), lambda x: {{'gap': abs(x - v), 'v': x}}))[least(3, c - 1)] AS far FROM b),
s AS (SELECT i, c, k, CASE WHEN far.v <= v THEN far.v ELSE v - far.gap END AS lo, CASE WHEN far.v >= v THEN far.v ELSE v + far.gap END AS hi, far.gap = 0 AS eq FROM f),
m AS (SELECT i, any_value(s.c) AS c, any_value(k) AS k, count(*) AS m FROM s JOIN b ON b.v >= s.lo AND b.v <= s.hi AND (eq OR (b.v > s.lo AND b.v < s.hi)) GROUP BY i)
SELECT round(greatest(0, {_PSI.format(x="count(*)::DOUBLE")} + avg({_PSI.format(x="k::DOUBLE")}) - avg({_PSI.format(x="c::DOUBLE")}) - avg({_PSI.format(x="m::DOUBLE")})), 6) AS mutual_info FROM m""",
)
def _(spark, d):
    told = statistics.neighbour_information(_t(spark, d, "events"), "value", "event_type")
    return spark.createDataFrame([(round(told, 6),)], "mutual_info double")


@query("pca_variance")
def _(spark, d):
    parts = statistics.principal_components(_t(spark, d, "lineitem"), _NUM)
    return spark.createDataFrame([(i, round(p["explained"], 6)) for i, p in enumerate(parts)], "component int, explained double")


@query("partial_corr", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial_corr FROM c")
def _(spark, d):
    matrix = statistics.correlation_matrix(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame([(round(statistics.partial_correlation(matrix, 0, 1, (2,)), 6),)], "partial_corr double")


@query("dependence_graph")
def _(spark, d):
    li = _t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_paid"))
    edges = statistics.dependence_graph(li, li.columns)
    return spark.createDataFrame([(e["src"], e["dst"], e["kind"], round(e["weight"], 6)) for e in edges], "src string, dst string, kind string, weight double")


@query("ks_stat", "WITH c AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1) SELECT round(max(gap), 8) AS ks FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM c WINDOW w AS (ORDER BY v))")
def _(spark, d):
    return statistics.ks_statistic(_t(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select(r(F.col("ks"), 8).alias("ks"))


@query("f_ratio", "SELECT round(var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') / var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A'), 8) AS f_ratio FROM lineitem")
def _(spark, d):
    x = lambda flag: F.var_samp(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return _t(spark, d, "lineitem").agg(r(x("R") / x("A"), 8).alias("f_ratio"))


@query("ols_ate", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def _(spark, d):
    return _t(spark, d, "lineitem").agg(r(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# --- series ---------------------------------------------------------------------------


def _daily(spark, d):
    return _t(spark, d, "orders").groupBy(F.date_trunc("day", F.col("o_orderdate")).alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_DAILY = "SELECT date_trunc('day', o_orderdate) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


@query("moving_profile", "WITH w AS (SELECT user_id, ts, avg(value) OVER x AS m, count(*) OVER x AS n FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)), f AS (SELECT * FROM w WHERE n = 16) SELECT user_id, ts, round(m, 6) AS window_mean, round(abs(m - avg(m) OVER (PARTITION BY user_id)), 6) AS distance FROM f")
def _(spark, d):
    return series.moving_profile(_t(spark, d, "events"), "ts", "value", ["user_id"], 16).select("user_id", "ts", r(F.col("window_mean")).alias("window_mean"), r(F.col("distance")).alias("distance"))


_SAX_LETTER = "CASE WHEN list_avg(w[{lo}:{hi}]) > 0.6744897501960817 THEN 'd' WHEN list_avg(w[{lo}:{hi}]) > 0 THEN 'c' WHEN list_avg(w[{lo}:{hi}]) > -0.6744897501960817 THEN 'b' ELSE 'a' END"
_SAX_WORD = " || ".join(_SAX_LETTER.format(lo=4 * i + 1, hi=4 * i + 4) for i in range(8))


@query(
    "sax_top_words",
    f"""WITH z AS (SELECT user_id, ts, (value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_samp(value) OVER (PARTITION BY user_id), 0) AS z FROM events),
x AS (SELECT user_id, list(coalesce(z, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS w FROM z)
SELECT word, n FROM (SELECT {_SAX_WORD} AS word, count(*) AS n FROM x WHERE len(w) = 32 GROUP BY 1) ORDER BY n DESC, word LIMIT 8""",
)
def _(spark, d):
    words = series.sax_words(_t(spark, d, "events"), "ts", "value", ["user_id"], 32, then=["event_id"])
    total = words.groupBy("word").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "word").limit(8)


@query("ffill_bfill", "WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events) SELECT user_id, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM e")
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", F.expr("if(event_id % 4 <> 0, value, null)").alias("value"))
    return series.filled(e, "ts", "value", ["user_id"])


@query("naive_seasonal", f"WITH d AS ({_DAILY}), t AS (SELECT total, row_number() OVER (ORDER BY day) - 1 AS k FROM (SELECT * FROM d ORDER BY day DESC LIMIT 7)) SELECT s.step, t.total AS forecast FROM range(0, 21) s(step) JOIN t ON s.step % 7 = t.k")
def _(spark, d):
    return series.naive_seasonal(_daily(spark, d), "day", "total", 21)


@query("regime_summary", f"WITH d AS ({_DAILY}), p AS (SELECT total, row_number() OVER (ORDER BY day) - 1 AS k FROM d) SELECT CAST((k >= 100)::INTEGER + (k >= 250)::INTEGER AS INTEGER) AS regime, count(*) AS n, round(avg(total), 4) AS mean, round(stddev_samp(total), 4) AS stdev, avg((total > 0)::INTEGER) AS rate FROM p GROUP BY 1")
def _(spark, d):
    s = series.regime_summary(_daily(spark, d), "day", "total", [100, 250])
    return s.select("regime", "n", r(F.col("mean"), 4).alias("mean"), r(F.col("stdev"), 4).alias("stdev"), "rate")


@query(
    "regime_classes",
    f"""WITH d AS ({_DAILY}), p AS (SELECT strftime(day, '%a') AS label, row_number() OVER (ORDER BY day) - 1 AS k FROM d), c AS (SELECT CAST((k >= 100)::INTEGER + (k >= 250)::INTEGER AS INTEGER) AS regime, label, count(*) AS k FROM p GROUP BY 1, 2)
SELECT regime, CAST(sum(k) AS BIGINT) AS n, min(label) FILTER (WHERE k = most) AS top, max(k) / sum(k) AS rate, count(*) AS n_unique FROM (SELECT *, max(k) OVER (PARTITION BY regime) AS most FROM c) GROUP BY 1""",
)
def _(spark, d):
    labelled = _daily(spark, d).select("day", F.date_format("day", "E").alias("label"))
    return series.regime_classes(labelled, "day", "label", [100, 250])


@query(
    "cusum_changes",
    """WITH RECURSIVE s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS z, count(*) OVER p AS n FROM events WINDOW p AS (PARTITION BY event_type)),
t AS (SELECT event_type, any_value(n) AS n, greatest(50, floor(any_value(n) * 0.05)) AS least FROM s GROUP BY 1),
c(event_type, i, up, down, alarm) AS (SELECT event_type, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, false FROM t WHERE n >= 20 UNION ALL
SELECT event_type, i, CASE WHEN greatest(u, d) > 4 THEN 0 ELSE u END, CASE WHEN greatest(u, d) > 4 THEN 0 ELSE d END, greatest(u, d) > 4 FROM (SELECT s.event_type, s.i, greatest(0, c.up + s.z - 0.5) AS u, greatest(0, c.down - s.z - 0.5) AS d FROM c JOIN s ON s.event_type = c.event_type AND s.i = c.i + 1)),
a AS (SELECT event_type, i, n, least FROM c JOIN t USING (event_type) WHERE alarm AND n - i >= least),
k(event_type, place, step) AS (SELECT event_type, 0::BIGINT, 0 FROM t UNION ALL SELECT k.event_type, min(a.i), k.step + 1 FROM k JOIN a ON a.event_type = k.event_type AND a.i - k.place >= a.least WHERE k.step < 7 GROUP BY k.event_type, k.step)
SELECT event_type, place, 'cusum' AS method FROM k WHERE step > 0""",
)
def _(spark, d):
    return series.change_points(_t(spark, d, "events"), "ts", "value", ["event_type"])


@query(
    "motifs_discords",
    """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY ALL),
p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, list(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS w FROM h),
m AS (SELECT *, list_avg(w) AS mean, list_stddev_pop(w) AS sd FROM p WHERE len(w) = 16 AND n >= 32),
z AS (SELECT event_type, i, list_transform(w, lambda x: (x - mean) / sd) AS z FROM m),
r AS (SELECT a.event_type, a.i, b.i AS j, round(list_dot_product(a.z, b.z) / 16, 10) AS r FROM z a JOIN z b ON b.event_type = a.event_type AND abs(b.i - a.i) > 4),
d AS (SELECT event_type, i AS place, j AS match, sqrt(2 * 16 * (1 - least(1, r))) AS distance FROM r QUALIFY row_number() OVER (PARTITION BY event_type, i ORDER BY r DESC, j) = 1)
SELECT event_type, 'motif' AS kind, place, match, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY distance, place) <= 3
UNION ALL SELECT event_type, 'discord', place, match, round(distance, 6) FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY distance DESC, place) <= 3""",
)
def _(spark, d):
    hourly = _t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return series.motifs_discords(hourly, "hour", "value", ["event_type"], 16).withColumn("distance", r(F.col("distance")))


@query("failure_clusters")
def _(spark, d):
    return clusters.cluster_rows(_t(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", ["value"])


@query(
    "sensor_flatlines",
    """WITH s AS (SELECT event_type, ts, floor(value / 25) AS v FROM events), m AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS new FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, v)),
k AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m)
SELECT event_type, any_value(v) AS v, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM k GROUP BY event_type, k HAVING count(*) > 1 AND epoch(max(ts)) - epoch(min(ts)) >= 3600""",
)
def _(spark, d):
    e = _t(spark, d, "events").select("event_type", "ts", F.floor(F.col("value") / 25).cast("double").alias("v"))
    return sensors.flatlines(e, "ts", "v", ["event_type"])


@query(
    "sensor_report",
    """WITH x AS (SELECT event_type, date_trunc('minute', ts) AS t, CASE WHEN event_id % 9 <> 0 THEN value - 5 END AS v FROM events), m AS (SELECT event_type, avg(v) AS mean, stddev_samp(v) AS sd FROM x GROUP BY 1),
t AS (SELECT event_type, t, count(*) AS n, count(*) FILTER (WHERE abs(v - mean) > 3 * sd) AS spikes, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE v IS NULL) AS missing FROM x JOIN m USING (event_type) GROUP BY 1, 2)
SELECT event_type, CAST(sum(spikes) AS BIGINT) AS n_spikes, CAST(sum(n - 1) AS BIGINT) AS n_stale, CAST(sum(negative) AS BIGINT) AS n_negative, CAST(sum(missing) AS BIGINT) AS n_missing FROM t GROUP BY 1""",
)
def _(spark, d):
    e = _t(spark, d, "events").select("event_type", F.date_trunc("minute", "ts").alias("t"), F.expr("if(event_id % 9 <> 0, value - 5, null)").alias("v"))
    return sensors.readings_report(e, "t", "v", ["event_type"])


@query(
    "calendar_gaps",
    """WITH t AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS after FROM events), g AS (SELECT *, lead(after) OVER (PARTITION BY user_id ORDER BY after) AS before FROM t)
SELECT user_id, after, before, CAST(ceil((epoch(before) - epoch(after)) / 3600) - 1 AS BIGINT) AS n_missing FROM g WHERE (epoch(before) - epoch(after)) / 3600 > 1""",
)
def _(spark, d):
    gaps = sensors.calendar_gaps(_t(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("ts")), "ts", ["user_id"], 3600)
    return gaps.select("user_id", F.col("after").cast("timestamp_ntz").alias("after"), F.col("before").cast("timestamp_ntz").alias("before"), "n_missing")


@query(
    "window_functions",
    """SELECT event_id, CAST(ntile(4) OVER w AS INTEGER) AS quarter, lead(value, 2) OVER w AS later, first_value(value) OVER w AS opening, nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third, round(percent_rank() OVER w, 9) AS share,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy("second").rangeBetween(-3600, 0)
    e = _t(spark, d, "events").withColumn("second", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("event_id", F.ntile(4).over(w).alias("quarter"), F.lead("value", 2).over(w).alias("later"), F.first("value").over(w).alias("opening"), F.nth_value("value", 3).over(whole).alias("third"), F.round(F.percent_rank().over(w), 9).alias("share"), F.count(F.lit(1)).over(hour).alias("last_hour"))


# --- features ---------------------------------------------------------------------------


def _expanded(df: DataFrame, tokens: list[str], keep: list[str], **context) -> DataFrame:
    out = expand(df, tokens, Context(**context))
    assert not out.leaks(Context(**context))
    return out.frame.select(*keep, *[r(F.col(c).cast("double")).alias(c) for c in out.columns])


_O = "o_orderkey, o_totalprice, o_custkey::DOUBLE AS cust, o_orderkey::DOUBLE AS num"


def _orders(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"), (F.col("o_orderkey") % 24).cast("double").alias("hour"), "o_orderpriority", "o_orderstatus", "o_orderdate")


_ORDERS_SQL = "(SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS cust, (o_orderkey % 24)::DOUBLE AS hour, o_orderpriority, o_orderstatus, o_orderdate FROM orders)"


@query("feat_interactions", f"SELECT o_orderkey, round(cust * hour, 6) AS X__cust_x_hour FROM {_ORDERS_SQL}")
def _(spark, d):
    return _expanded(_orders(spark, d), ["engineered:interactions_top3"], ["o_orderkey"], row_id="o_orderkey", target="o_totalprice", interactions=(("cust", "hour"), ("cust", "o_totalprice")))


@query("feat_ratios", f"SELECT o_orderkey, round(cust / nullif(hour, 0), 6) AS X__cust_div_hour FROM {_ORDERS_SQL}")
def _(spark, d):
    return _expanded(_orders(spark, d), ["engineered:ratios"], ["o_orderkey"], row_id="o_orderkey", target="o_totalprice")


@query("feat_polynomial", f"SELECT o_orderkey, cust * cust AS X__cust_sq, hour * hour AS X__hour_sq, hour * hour * hour AS X__hour_cube, cust * cust * cust AS X__cust_cube FROM {_ORDERS_SQL}")
def _(spark, d):
    return _expanded(_orders(spark, d), ["engineered:polynomial_2", "engineered:polynomial_3"], ["o_orderkey"], row_id="o_orderkey", target="o_totalprice")


@query("feat_cyclic", f"SELECT o_orderkey, round(sin(2 * pi() * hour / 24.0), 6) + 0.0 AS X__hour_sin, round(cos(2 * pi() * hour / 24.0), 6) + 0.0 AS X__hour_cos FROM {_ORDERS_SQL}")
def _(spark, d):
    return _expanded(_orders(spark, d), ["engineered:cyclic"], ["o_orderkey"], row_id="o_orderkey", target="o_totalprice")


@query("feat_lag", "SELECT event_id, round(lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS X__value_lag2 FROM events")
def _(spark, d):
    return _expanded(_t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["engineered:lag_2"], ["event_id"], time="ts", group="user_id", row_id="event_id")


@query("feat_lag_ratio", "SELECT event_id, round(lag(value / nullif(k, 0), 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS X__value_div_k_lag1 FROM (SELECT *, (event_id % 5)::DOUBLE AS k FROM events)")
def _(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "value", (F.col("event_id") % 5).cast("double").alias("k"))
    return _expanded(e, ["engineered:lag_x_ratio"], ["event_id"], time="ts", group="user_id", row_id="event_id")


@query("feat_lag_downstream", "SELECT event_id, round(lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS X__value_lagdown3 FROM events")
def _(spark, d):
    return _expanded(_t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["+lag_downstream"], ["event_id"], time="ts", group="user_id", row_id="event_id", lag_policy="use_window_3")


@query("feat_frequency", "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT v, dense_rank() OVER (ORDER BY n) / (SELECT count(*) FROM orders)::DOUBLE AS f FROM c), c2 AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1), f2 AS (SELECT v, dense_rank() OVER (ORDER BY n) / (SELECT count(*) FROM orders)::DOUBLE AS f FROM c2) SELECT o_orderkey, round(f.f, 6) AS X__o_orderpriority_freq, round(f2.f, 6) AS X__o_orderstatus_freq FROM orders JOIN f ON f.v = o_orderpriority JOIN f2 ON f2.v = o_orderstatus")
def _(spark, d):
    return _expanded(_orders(spark, d), ["engineered:frequency_encoding"], ["o_orderkey"], row_id="o_orderkey", target="o_totalprice")


@query("feat_qbin", "WITH e AS (SELECT list_distinct([quantile_cont(l_quantity, 0.2), quantile_cont(l_quantity, 0.4), quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.8)]) AS q FROM lineitem) SELECT l_quantity, count(*) AS n, len(list_filter(q, lambda x: x < l_quantity))::DOUBLE AS X__l_quantity_qbin5 FROM lineitem, e GROUP BY l_quantity, q")
def _(spark, d):
    out = _expanded(_t(spark, d, "lineitem").select("l_quantity"), ["engineered:binning_quantile_5"], ["l_quantity"])
    return out.groupBy("l_quantity", "X__l_quantity_qbin5").agg(F.count("*").alias("n"))


@query(
    "feat_target_encoding",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS v, o_orderkey % 5 AS f, o_totalprice AS y FROM orders), a AS (SELECT v, f, sum(y) AS s, count(y) AS n FROM o GROUP BY 1, 2),
b AS (SELECT v, f, sum(s) OVER (PARTITION BY v) - s AS os, sum(n) OVER (PARTITION BY v) - n AS onn, (sum(s) OVER () - sum(s) OVER (PARTITION BY f)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY f)) AS p FROM a)
SELECT o_orderkey, round((os + 10 * p) / (onn + 10), 4) AS te FROM o JOIN b USING (v, f)""",
)
def _(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 5).alias("fold"))
    out = expand(o, ["engineered:target_encoding"], Context(row_id="o_orderkey", target="o_totalprice", fold="fold"))
    return out.frame.select("o_orderkey", r(F.col("X__o_orderpriority_te"), 4).alias("te"))


@query("feat_autoencoded")
def _(spark, d):
    out = expand(_t(spark, d, "lineitem").select(_NUM), ["engineered:autoencoded"], Context())
    return out.frame.agg(*[r(F.avg(c), 6).alias(c) for c in out.columns])


@query("feat_all_allowed", f"SELECT cust, hour, o_orderpriority, o_orderstatus FROM {_ORDERS_SQL}")
def _(spark, d):
    out = expand(_orders(spark, d), ["+all_allowed"], Context(target="o_totalprice", time="o_orderdate", row_id="o_orderkey"))
    return out.frame.select(out.columns)


# --- sampling -----------------------------------------------------------------------------


@query("coreset_weights_class", "WITH w AS (SELECT o_orderkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS w FROM orders) SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def _(spark, d):
    return sampling.class_weights(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", r(F.col("weight")).alias("weight"))


@query("coreset_weights_regression", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders), a AS (SELECT o_orderkey, abs(o_totalprice - m) AS a FROM orders, m), w AS (SELECT o_orderkey, 1 + a / (SELECT median(a) FROM a) AS w FROM a) SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def _(spark, d):
    return sampling.regression_weights(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", r(F.col("weight")).alias("weight"))


@query("coreset_weights_recency", "WITH k AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS k FROM orders), w AS (SELECT o_orderkey, 0.1 + 1.9 * (k::DOUBLE / (SELECT max(k) FROM k)) AS w FROM k) SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def _(spark, d):
    return sampling.recency_weights(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", r(F.col("weight")).alias("weight"))


@query("coreset_sample")
def _(spark, d):
    weighed = sampling.class_weights(_t(spark, d, "orders"), "o_orderstatus")
    return sampling.weighted_sample(weighed, "weight", ["o_orderkey"], 500).select("o_orderkey", "o_orderstatus", r(F.col("weight")).alias("weight"))


@query("split_stratified", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_orderstatus").transform(sampling.stratified_folds, "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")


@query("split_group", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, (row_number() OVER (ORDER BY n DESC, o_custkey) - 1) % 10 AS t FROM s) SELECT o_custkey, CAST(CASE WHEN t < 5 THEN t ELSE 9 - t END AS INTEGER) AS fold FROM p")
def _(spark, d):
    return sampling.group_folds(_t(spark, d, "orders"), "o_custkey")


_FOLDS = "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events), f AS (SELECT event_id, k, n // {parts} AS c, CAST(fold AS INTEGER) AS fold FROM p, range(1, 6) r(fold)), o AS (SELECT event_id, fold, CASE WHEN k <= fold * c THEN 'train' WHEN k > fold * c + {gap} AND k <= fold * c + {gap} + c THEN 'valid' END AS role FROM f) SELECT * FROM o WHERE role IS NOT NULL"


@query("split_time", _FOLDS.format(parts=6, gap=0))
def _(spark, d):
    return sampling.time_folds(_t(spark, d, "events"), "ts", "event_id")


@query("split_rolling", _FOLDS.format(parts=7, gap=6))
def _(spark, d):
    return sampling.time_folds(_t(spark, d, "events"), "ts", "event_id", parts=7, gap=6)


@query("split_positional", "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN k < floor(n * 0.8) THEN 'train' ELSE 'valid' END AS role FROM p")
def _(spark, d):
    return sampling.positional_split(_t(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "role")


@query("impute_median", "WITH e AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value FROM e")
def _(spark, d):
    e = _t(spark, d, "events").select("event_id", F.expr("if(event_id % 6 <> 0, value, double('NaN'))").alias("value"))
    return models.imputed(e, ["value"]).select("event_id", r(F.col("value")).alias("value"))


# --- metrics -------------------------------------------------------------------------------


def _scored(spark, d):
    """Labels and scores that depend on the order only, with ties."""
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31, F.lit(101)) / 100.0).alias("p"))


_S = "(SELECT o_orderkey AS id, (o_orderstatus = 'F')::INTEGER AS y, ((o_orderkey * 7919 + o_custkey * 31) % 101) / 100.0::DOUBLE AS p FROM orders)"


def _forecast(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("p"))


_FC = "(SELECT l_quantity AS y, l_extendedprice / 1000 AS p FROM lineitem)"


@query("metric_regression", f"SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(avg(CASE WHEN abs(y) > 1e-9 THEN abs((y - p) / y) END), 6) AS mape, round(avg(CASE WHEN abs(y) + abs(p) > 0 THEN abs(y - p) / ((abs(y) + abs(p)) / 2) END), 6) AS smape, round(1 - sum((y - p) * (y - p)) / regr_syy(y, y), 6) AS r2 FROM {_FC}")
def _(spark, d):
    names = ["rmse", "mae", "mape", "smape", "r2"]
    return metrics.plain(_forecast(spark, d), names).select(*[r(F.col(n)).alias(n) for n in names])


@query("metric_probability", f"SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END), 6) AS log_loss, round(avg((y - p) * (y - p)), 6) AS brier FROM {_S}")
def _(spark, d):
    return metrics.plain(_scored(spark, d), ["log_loss", "brier"]).select(r(F.col("log_loss")).alias("log_loss"), r(F.col("brier")).alias("brier"))


@query("metric_roc_auc", f"WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM {_S}) SELECT round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM r")
def _(spark, d):
    return metrics.roc_auc(_scored(spark, d)).select(r(F.col("roc_auc")).alias("roc_auc"))


@query("metric_average_precision", f"WITH g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM {_S} GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * (tp / n)) / sum(pos), 6) AS average_precision FROM c")
def _(spark, d):
    return metrics.average_precision(_scored(spark, d)).select(r(F.col("average_precision")).alias("average_precision"))


@query("metric_precision_at_k", f"SELECT avg(y)::DOUBLE AS precision_at_k FROM (SELECT y FROM {_S} ORDER BY p DESC, id LIMIT 10)")
def _(spark, d):
    return metrics.precision_at(_scored(spark, d))


@query("metric_top_percent", f"WITH s AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k, count(*) OVER () AS n, sum(y) OVER () AS pos FROM {_S}), q AS (SELECT CAST(q AS INTEGER) AS percent FROM (VALUES (1), (2), (5), (10), (20)) v(q)), z AS (SELECT percent, greatest(1, least(n, round_even(percent / 100.0 * n, 0)))::DOUBLE AS size, k, y, pos, n FROM s, q) SELECT percent, round(sum(y) / any_value(pos)::DOUBLE, 6) AS recall, round(sum(y) / any_value(size), 6) AS precision, round(sum(y) / any_value(size) / (any_value(pos)::DOUBLE / any_value(n)), 6) AS lift FROM z WHERE k <= size GROUP BY percent")
def _(spark, d):
    return metrics.top_percent(_scored(spark, d)).select("percent", *[r(F.col(c)).alias(c) for c in ("recall", "precision", "lift")])


@query("metric_ece", f"WITH b AS (SELECT count(*) AS n, avg(y) AS y, avg(p) AS p FROM {_S} GROUP BY least(floor(p * 15), 14)) SELECT round(sum(n * abs(y - p)) / sum(n), 6) AS ece FROM b")
def _(spark, d):
    return metrics.ece(_scored(spark, d)).select(r(F.col("ece")).alias("ece"))


@query("metric_calibration", f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(p), 6) AS predicted FROM {_S} GROUP BY 1")
def _(spark, d):
    return metrics.calibration(_scored(spark, d)).select("bin", "n", r(F.col("observed")).alias("observed"), r(F.col("predicted")).alias("predicted"))


@query("metric_ndcg", f"WITH a AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS k FROM {_S}), b AS (SELECT y, row_number() OVER (ORDER BY y DESC, id) AS k FROM {_S}) SELECT round((SELECT sum((2.0 ** y - 1) / log2(k + 1)) FROM a WHERE k <= 10) / (SELECT sum((2.0 ** y - 1) / log2(k + 1)) FROM b WHERE k <= 10), 6) AS ndcg")
def _(spark, d):
    return metrics.ndcg(_scored(spark, d)).select(r(F.col("ndcg")).alias("ndcg"))


@query("metric_spearman", f"WITH r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM {_FC}) SELECT round(corr(a, b), 6) AS spearman FROM r")
def _(spark, d):
    return metrics.spearman(_forecast(spark, d)).select(r(F.col("spearman")).alias("spearman"))


_CI = "(SELECT l_quantity AS y, l_discount AS p FROM lineitem)"


@query("metric_concordance", f"WITH c AS (SELECT y, p, count(*) AS n FROM {_CI} GROUP BY 1, 2) SELECT round(sum(CASE WHEN a.p > b.p THEN a.n * b.n ELSE 0 END) / sum(a.n * b.n)::DOUBLE, 6) AS concordance FROM c a JOIN c b ON a.y < b.y")
def _(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), F.col("l_discount").alias("p"))
    return metrics.concordance(li).select(r(F.col("concordance")).alias("concordance"))


@query("metric_aliases", f"WITH s AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k, count(*) OVER () AS n FROM {_S}), t AS (SELECT sum(y) FILTER (WHERE k <= greatest(1, least(n, round_even(0.1 * n, 0))))::DOUBLE AS hit, any_value(greatest(1, least(n, round_even(0.1 * n, 0))))::DOUBLE AS size, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s) SELECT round(hit / pos, 6) AS top_k_capture_rate, round(hit / size, 6) AS precision_at_top_k, round(hit / size / (pos / n), 6) AS lift_at_top_k FROM t")
def _(spark, d):
    rows = _scored(spark, d)
    parts = [metrics.named(n)(rows).toDF(n).select(r(F.col(n)).alias(n)) for n in ("top_k_capture_rate", "precision_at_top_k", "lift_at_top_k")]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each


@query("metric_population", f"SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END), 6) AS log_loss_pop, round(avg((y - p) * (y - p)), 6) AS brier_pop FROM {_S}")
def _(spark, d):
    found = models.population(_scored(spark, d), ("log_loss", "brier", "ibs"))
    return spark.createDataFrame([{k: round(v, 6) for k, v in found.items()}], "log_loss_pop double, brier_pop double")


# --- vectors, logs, text --------------------------------------------------------------------


@query("cosine_topk", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS similarity FROM embeddings, q), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS INTEGER) AS place FROM s) SELECT query_id, vec_id, place, round(similarity, 6) AS similarity FROM p WHERE place <= 10")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    best = vectors.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    return best.select("query_id", "vec_id", "place", r(F.col("similarity")).alias("similarity"))


@query("running_budget", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "events").select("event_id", "user_id", r(F.sum("value").over(w), 4).alias("total"))


@query("max_by_best", "SELECT event_type, arg_max(event_id, value) AS best, max(value) AS best_value FROM events GROUP BY 1")
def _(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", "value").alias("best"), F.max("value").alias("best_value"))


@query("latest_wins", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return latest_wins(_t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts")


@query("first_wins", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1 ORDER BY event_id LIMIT 12")
def _(spark, d):
    return tables.first_wins(_t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id").orderBy("event_id").limit(12)


@query(
    "pair_upsert",
    """WITH a AS (SELECT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b, round(max(value), 4) AS strength FROM events WHERE value < 50 GROUP BY 1, 2), n AS (SELECT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b, round(min(value), 4) AS strength FROM events WHERE value >= 50 GROUP BY 1, 2)
SELECT a, b, strength FROM (SELECT * FROM n UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.a = a.a AND n.b = a.b)) ORDER BY strength DESC, a, b LIMIT 10""",
)
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("other"), "value", "event_id")
    held = lambda rows, best: e.where(rows).groupBy(F.least("user_id", "other").alias("x"), F.greatest("user_id", "other").alias("y")).agg(F.round(best, 4).alias("strength"))
    return tables.pair_upsert(held("value < 50", F.max("value")), held("value >= 50", F.min("value")), "x", "y", "strength", 10).select(F.col("x").alias("a"), F.col("y").alias("b"), "strength")


@query("library_summary", "SELECT count(DISTINCT user_id) AS projects, count(*) AS hypotheses, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS domains FROM events")
def _(spark, d):
    return _t(spark, d, "events").agg(F.count_distinct("user_id").alias("projects"), F.count(F.lit(1)).alias("hypotheses"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("domains"))


@query("newest_best_first", "SELECT event_id, year, score FROM (SELECT event_id, extract(day FROM ts)::INTEGER AS year, value AS score FROM events) ORDER BY year DESC, score DESC, event_id LIMIT 20")
def _(spark, d):
    e = _t(spark, d, "events").select("event_id", F.dayofmonth("ts").alias("year"), F.col("value").alias("score"))
    return e.orderBy(F.desc("year"), F.desc("score"), "event_id").limit(20)


@query("bandit_posteriors", "SELECT event_type AS family, round((1 + sum(least(1, greatest(0, value / 100)))) / (2 + count(*)), 6) AS posterior_mean FROM events GROUP BY 1")
def _(spark, d):
    reward = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("family")).agg(r((1 + F.sum(reward)) / (2 + F.count("*"))).alias("posterior_mean"))


@query("improvement_flags", "SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return _t(spark, d, "events").select("event_id", F.coalesce(F.col("value") > F.max("value").over(w), F.lit(True)).alias("improved"))


@query("name_words", "SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[\\s\\-]+', '_', 'g'), '_'), lambda w: w <> ''), ',') AS words FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(S.name_words(F.col("p_name")), ",").alias("words"))


@query("hint_predicate", "SELECT p_partkey, (contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass')) AS hinted FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.contains_any(F.col("p_type"), ("steel", "brass")).alias("hinted"))


@query("fingerprint_sha1", "SELECT p_partkey, substr(sha1(concat_ws('|', p_name, p_brand, p_type)), 1, 10) AS fingerprint FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("fingerprint"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("doc_lengths", "SELECT doc_id, length(text) AS n_chars, octet_length(encode(text)) AS n_bytes, length(text) > 20000 AS long FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), (F.length("text") > 20000).alias("long"))


@query("quantile_lookup", "SELECT round(quantile_cont(l_quantity, 0.25) + (quantile_cont(l_quantity, 0.5) - quantile_cont(l_quantity, 0.25)) * 0.4, 6) AS q35, round(quantile_cont(l_quantity, 0.99), 6) AS q999 FROM lineitem")
def _(spark, d):
    p = profile.column_profile(_t(spark, d, "lineitem").select("l_quantity"))
    at = lambda q: r(S.quantile_of(F.col("quantiles"), profile.QUANTILES, q))
    return p.select(at(0.35).alias("q35"), at(0.999).alias("q999"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    t = windows.tumbling(_t(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("total"), 4).alias("total"))


@query(
    "stream_join",
    """SELECT a.event_id, a.user_id, a.ts AS began, b.event_id AS next_id, b.ts AS ended FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS
WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type = (SELECT max(event_type) FROM events)""",
)
def _(spark, d):
    e = _t(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))))
    began = e.where("event_type = lo").select("event_id", "user_id", F.col("ts").alias("began"))
    ended = e.where("event_type = hi").select(F.col("event_id").alias("next_id"), "user_id", F.col("ts").alias("ended"))
    return windows.joined(began, ended, ["user_id"], "began", "ended", "2 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


@query("stream_distinct", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    return windows.distinct_events(e, ["user_id", "event_type", "hour"], "hour").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    s = windows.sessions(_t(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
