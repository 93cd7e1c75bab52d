"""Series and joins that are cut into ranges, blocks and bins, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import joins, running, sensors, series, statistics


def _by(rows, key, value):
    found = {}
    for r in rows:
        found.setdefault(r[key], []).append(r[value])
    return found


@pytest.fixture(scope="module")
def shifts(spark):
    """Three series: one of 1,200 values that shifts twice, one without a key and with gaps, one that is constant."""
    draw = np.random.default_rng(1)
    v = np.r_[draw.normal(0, 1, 400), draw.normal(2, 1, 400), draw.normal(-1, 1, 400)]
    gaps = [None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(x) for i, x in enumerate(v[:500])]
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [(None, i, x) for i, x in enumerate(gaps)] + [("c", i, 1.0) for i in range(100)] + [("short", i, float(i)) for i in range(10)]
    return v, np.array([np.nan if x is None else x for x in gaps]), spark.createDataFrame(rows, "g string, t long, v double").repartition(5)


def _known(values):
    """Gaps take the last known value, those before the first one the first."""
    out, last = [], next(x for x in values if x == x)
    for x in values:
        last = x if x == x else last
        out.append(last)
    return np.array(out)


@pytest.mark.parametrize("block", [60, 5000])
def test_alarms_are_the_loops_for_any_ranges(spark, shifts, block):
    v, gaps, df = shifts
    got = _by(series.cusum_alarms(df, "t", "v", ["g"], block).collect(), "g", "place")
    assert {k: sorted(x) for k, x in got.items()} == {"a": series.cusum(v), None: series.cusum(_known(gaps))}


def test_sums_that_never_fall_back(spark):
    """Sums that stay above zero for whole ranges take a round for each, and are right still."""
    z = np.r_[np.full(40, 0.6), np.full(40, 0.4)] - 0.5
    up, down, alarms = 1.0, 0.0, []
    whole = series._scan(up, down, z + 0.5)
    for i in range(0, 80, 10):
        up, down, its = series._scan(up, down, z[i : i + 10] + 0.5)
        alarms += [i + a for a in its]
    assert (up, down, alarms) == whole


def test_change_points(spark, shifts):
    v, gaps, df = shifts
    got = _by(series.change_points(df, "t", "v", ["g"], block=300).collect(), "g", "place")
    assert {k: sorted(x) for k, x in got.items()} == {"a": series.regime_bounds(series.cusum(v), 1200), None: series.regime_bounds(series.cusum(_known(gaps)), 500)}
    assert series.change_points(df.where("g = 'c'"), "t", "v", ["g"]).count() == series.change_points(df.limit(0), "t", "v", ["g"]).count() == 0


@pytest.mark.parametrize("block", [30, 150, 5000])
def test_matrix_profile_in_tiles(spark, shifts, block):
    v, gaps, df = shifts
    rows = series.nearest_windows(df, "t", "v", ["g"], 16, block).collect()
    for key, values in (("a", v), (None, gaps[~np.isnan(gaps)]), ("c", np.ones(100))):
        got = {r["place"]: (r["match"], r["distance"]) for r in rows if r["g"] == key}
        distance, place = series.matrix_profile(values, 16)
        assert sorted(got) == list(range(len(distance)))
        assert [got[i][0] for i in range(len(place))] == place.tolist() and [got[i][1] for i in range(len(place))] == pytest.approx(distance.tolist(), abs=1e-9)
    assert {r["g"] for r in rows} == {"a", None, "c"}


def test_flat_windows():
    values = np.r_[np.zeros(20), np.arange(20.0), np.zeros(20)]
    distance, place = series.matrix_profile(values, 8)
    assert distance[0] == 0 and place[0] == 3 and distance[20] == 0
    values = np.r_[np.zeros(8), np.sin(np.arange(40) ** 1.5)]
    assert series.matrix_profile(values, 8)[0][0] == pytest.approx(8**0.5)


def test_motifs_and_discords_have_no_group_per_series(spark, shifts):
    _, _, df = shifts
    found = series.motifs_discords(df, "t", "v", ["g"], 16, 2, 100)
    rows = [r for r in found.collect() if r["g"] == "a"]
    distance, _ = series.matrix_profile(shifts[0], 16)
    assert sorted(r["distance"] for r in rows if r["kind"] == "motif") == pytest.approx(sorted(distance)[:2])
    assert sorted(r["distance"] for r in rows if r["kind"] == "discord") == pytest.approx(sorted(distance)[-2:])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_filled_and_flat_stretches(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", None]), i // 2, draw.choice([None, 1.0, 1.0, 2.0])) for i in range(300)]
    df = spark.createDataFrame([(g, t, v, i) for i, (g, t, v) in enumerate(rows)], "g string, t long, v double, i long").withColumn("ts", F.timestamp_seconds(F.col("t") * 60 + F.col("i") % 2))
    got = {r["i"]: r["v"] for r in series.filled(df, "ts", "v", ["g"]).collect()}
    for key in ("a", None):
        own = [(i, v) for i, (g, _, v) in enumerate(rows) if g == key]
        assert [got[i] for i, _ in own] == _known([np.nan if v is None else v for _, v in own]).tolist()
    stretches = sensors.flatlines(df, "ts", "v", ["g"], 120)
    want = 0
    for key in ("a", None):
        own = [(t * 60 + i % 2, v) for i, (g, t, v) in enumerate(rows) if g == key and v is not None]
        cuts = [0, *[i for i in range(1, len(own)) if own[i][1] != own[i - 1][1]], len(own)]
        want += sum(own[b - 1][0] - own[a][0] >= 120 and b - a > 1 for a, b in zip(cuts, cuts[1:], strict=False))
    assert stretches.count() == want > 3


def test_carried_values(spark):
    rows = [(i, i % 3, None if i % 4 else i * 10) for i in range(50)]
    df = spark.createDataFrame(rows, "t int, g int, x int")
    for current in (True, False):
        got = {r["t"]: r["last"] for r in running.carried(df, "t", {"last": F.col("x")}, ["g"], ranges=8, current=current).collect()}
        for t, g, _ in rows:
            known = [x for s, h, x in rows if h == g and x is not None and (s <= t if current else s < t)]
            assert got[t] == (known[-1] if known else None)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_asof_by_ranges_of_time(spark, keys):
    draw = random.Random(3)
    left = [(i, draw.choice(["hot"] * 9 + ["cold", None]), draw.choice([None, *range(200)])) for i in range(400)]
    right = [(i, draw.choice(["hot"] * 9 + ["cold", None]), draw.choice([None, *range(200)])) for i in range(150)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "w int, k string, t int")
    found = joins.asof_join(a.repartition(3), b, "t", keys, "r", tiebreak="w", hot=True)
    want = {}
    for i, k, t in left:
        known = [(s, w) for w, h, s in right if t is not None and s is not None and s <= t and (not keys or h == k)]
        want[i] = max(known)[1] if known else None
    assert {r["i"]: r["w"] for r in found.collect()} == want
    if not keys:
        same = joins.asof_join(a, b, "t", suffix="r", tiebreak="w")
        assert {r["i"]: r["w"] for r in same.collect()} == want and "k_r" in same.columns
        plain = joins.asof_join(a.withColumn("t", F.format_string("%04d", "t")), b.withColumn("t", F.format_string("%04d", "t")), "t", suffix="r", tiebreak="w")
        assert plain.count() == 400  # a time that is no number goes through a window


def _plain_information(v, y, k=3):
    """Ross's estimator by all distances."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    rows = [i for i in range(len(v)) if y.count(y[i]) > 1]
    terms = []
    for i in rows:
        own = sorted(abs(v[j] - v[i]) for j in rows if j != i and y[j] == y[i])
        near = min(k, len(own))
        r = own[near - 1]
        m = sum(abs(v[j] - v[i]) < r or (r == 0 and v[j] == v[i]) for j in rows)
        terms.append(psi(near) - psi(len(own) + 1) - psi(m))
    return max(0.0, psi(len(rows)) + sum(terms) / len(terms))


@pytest.mark.parametrize("block", [16, 4096])
def test_information_of_neighbours(spark, block):
    draw = random.Random(6)
    rows = [(draw.gauss({"a": 0, "b": 1, None: 0}[y], 1), y) for y in draw.choices(["a", "b", None], k=250)] + [(5.0, "b")] * 6 + [(0.5, "lone"), (None, "a")]
    df = spark.createDataFrame(rows, "x double, y string").withColumn("noise", F.xxhash64("x") % 1000)
    known = [(x, y) for x, y in rows if x is not None and y is not None]
    told = statistics.neighbour_information(df, "x", "y", block=block)
    assert told == pytest.approx(_plain_information(*map(list, zip(*known, strict=True))), abs=1e-9) and told > 0.05
    if block > 16:
        assert statistics.neighbour_information(df.limit(0), "x", "y") == 0
        assert statistics.shortlist(df, ["noise", "x"], "y", 1) == ["x"] and statistics.shortlist(df, ["noise"], "y", 1) == ["noise"]


def _spans(n, seed, gap=0):
    draw = random.Random(seed)
    rows = [(i, draw.randint(0, 1000) + gap, draw.choice([0, 0, 1, 3, 20, 400]), draw.choice("ab")) for i in range(n)]
    return [(i, a, a + w, k if i % 50 else None) for i, a, w, k in rows]


@pytest.mark.parametrize(("width", "bin_rows"), [(None, 50_000), (1.0, 3), (50.0, 10), (5000.0, 40)])
def test_interval_join(spark, width, bin_rows):
    left = [*_spans(250, 1), (900, 5, 1, "a"), (901, None, 1, "a"), (902, 90_000, 90_001, "a"), (903, 3, 3, "b"), (903, 3, 3, "b")]
    right = _spans(180, 2, 7)
    a, b = spark.createDataFrame(left, "i long, s long, e long, k string"), spark.createDataFrame(right, "j long, s long, e long, k string")
    proper = [x for x in left if x[1] is not None and x[1] <= x[2]]
    want = sorted((x[0], y[0]) for x in proper for y in right if x[3] == y[3] and x[1] <= y[2] and y[1] <= x[2])
    found = joins.interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], width=width, bin_rows=bin_rows)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == want and found.columns == ["i", "s", "e", "k", "j", "s_right", "e_right"]
    outer = joins.interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], "left", width=width, bin_rows=bin_rows)
    met = {i for i, _ in want}
    assert outer.count() == len(want) + sum(x[0] not in met for x in left)


def test_interval_join_without_keys(spark):
    points = spark.createDataFrame([(i, i * 3) for i in range(100)], "i long, p long").withColumn("p", F.timestamp_seconds("p"))
    spans = spark.createDataFrame([("x", 10, 40), ("y", 200, 200), ("z", 250, 900)], "n string, s long, e long").select("n", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    found = joins.interval_join(points, spans, ("p", "p"), ("s", "e"))
    assert sorted((r["n"], r["i"]) for r in found.collect()) == [("x", i) for i in range(4, 14)] + [("z", i) for i in range(84, 100)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.interval_join(points.limit(0), spans, ("p", "p"), ("s", "e")).count() == 0
    with pytest.raises(ValueError):
        joins.interval_join(points, spans, ("p", "p"), ("s", "e"), how="outer")
