"""Running sums by ranges against plain loops, and streams against tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import scalars
from tarnwell.operators import clusters, metrics, running, series, statistics, vectors
from tarnwell.sources import tables
from tarnwell.streaming import windows


def _rows(spark, n=400, seed=1):
    draw = random.Random(seed)
    return [(i, draw.choice("ab"), draw.choice([None, *range(30)]), draw.randint(1, 5)) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_running_sums(spark, descending, ranges):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, "id long, g string, v int, n int")
    got = {r["id"]: (r["s"], r["k"]) for r in running.running(df, "v", {"s": F.col("n"), "k": F.lit(1)}, by=["g"], then=["id"], descending=descending, ranges=ranges).collect()}
    place = lambda r: ((r[2] is not None, r[2] or 0) if not descending else (r[2] is None, -(r[2] or 0)), r[0])
    want = {}
    for group in "ab":
        total = count = 0
        for r in sorted((r for r in rows if r[1] == group), key=place):
            want[r[0]] = (total, count)
            total, count = total + r[3], count + 1
    assert got == want


def test_exact_quantiles(spark):
    draw = random.Random(2)
    values = [draw.choice([1.0, 2.0, 7.5, draw.random() * 100]) for _ in range(501)]
    cells = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").count()
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    assert running.quantiles(cells, "v", "count", at).first()["quantiles"] == pytest.approx(np.quantile(values, at).tolist())
    assert running.quantiles(cells.limit(0), "v", "count", at).first()["quantiles"][0] is None


def test_ranking_metrics_by_loops(spark):
    draw = random.Random(3)
    rows = [(i, float(draw.randint(0, 40)), float(draw.randint(0, 15))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y double, p double")
    pairs = [(a, b) for a in rows for b in rows if a[1] < b[1]]
    assert metrics.concordance(df).first()[0] == pytest.approx(sum(a[2] > b[2] for a, b in pairs) / len(pairs))
    plan = metrics.concordance(df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoopJoin BuildRight, Inner, (" not in plan
    for percent, row in ((r["percent"], r) for r in metrics.top_percent(df.withColumn("y", (F.col("y") > 20).cast("double"))).collect()):
        size = max(1, min(150, round(percent / 100 * 150)))
        best = sorted(rows, key=lambda r: (-r[2], r[0]))[:size]
        assert row["precision"] == pytest.approx(sum(r[1] > 20 for r in best) / size)


def test_nearest_vectors(spark):
    draw = np.random.default_rng(4)
    data = [(i, draw.normal(size=6).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 6)]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    got = vectors.nearest(df.where("id % 20 = 0"), df, "id", "v", 4).collect()
    x = np.array([v for _, v in data[:60]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:4].tolist()
        assert [r["id"] for r in sorted(got, key=lambda r: r["place"]) if r["query_id"] == q] == want
    assert len(got) == 12


@pytest.mark.parametrize(("pivots", "rows"), [(1, 8192), (12, 16), (64, 8192)])
def test_knn_join_is_exact(spark, monkeypatch, pivots, rows):
    monkeypatch.setattr(vectors, "TILE_ROWS", rows)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 4)
    draw = np.random.default_rng(9)
    x = np.r_[draw.normal(size=(150, 4)) * 0.1, draw.normal(size=(50, 4)) * 0.1 + 5, draw.normal(size=(40, 4)), np.zeros((3, 4))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    got = vectors.knn_join(df.where("id % 10 = 0"), df, "id", "v", 5, pivots).collect()
    for q in range(0, 243, 10):
        gaps = np.round(np.linalg.norm(x - x[q], axis=1), 9)
        want = sorted(range(len(x)), key=lambda i: (gaps[i], i))[:5]
        rows_of = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])
        assert [r["id"] for r in rows_of] == want and [r["distance"] for r in rows_of] == pytest.approx(gaps[want].tolist(), abs=1e-6)
    assert vectors.knn_join(df.limit(0), df, "id", "v").count() == vectors.knn_join(df, df.limit(0), "id", "v").count() == 0


def test_matrix_profile_by_loops():
    draw = np.random.default_rng(5)
    v, m = draw.normal(size=60), 8
    distance, place = series.matrix_profile(v, m)
    z = np.array([(v[i : i + m] - v[i : i + m].mean()) / v[i : i + m].std() for i in range(60 - m + 1)])
    for i in range(len(z)):
        far = [j for j in range(len(z)) if abs(i - j) > 2]
        d = [np.linalg.norm(z[i] - z[j]) for j in far]
        assert distance[i] == pytest.approx(min(d), abs=1e-6) and place[i] == far[int(np.argmin(d))]


def test_principal_components_are_numpys(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert [p["explained"] for p in statistics.principal_components(df, ["a", "b", "c"])] == pytest.approx((values / values.sum()).tolist(), abs=1e-9)
    edges = {(e["src"], e["dst"]) for e in statistics.dependence_graph(df, ["a", "b", "c"])}
    assert edges and edges <= {("a", "b"), ("b", "c"), ("b", "a"), ("c", "b"), ("a", "c"), ("c", "a")}


def test_stream_equals_table(spark, tmp_path):
    """Windows over a stream of files, finished, are those of the table, but for the last that the watermark still holds open."""
    events = spark.range(400).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("value"))
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = windows.stream_to_table(windows.tumbling(stream, "ts", "1 hour", ["k"], "value"), "w", f"{tmp_path}/out", f"{tmp_path}/state")
    assert query.awaitTermination(120) and query.exception() is None
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in windows.tumbling(events, "ts", "1 hour", ["k"], "value").collect()}
    last = max(r[0] for r in want)
    assert got <= want and {r for r in want if r[0] < last} <= got
    assert windows.sessions(events, "ts", "5 minutes", ["k"]).count() == 3


def test_column_functions(spark):
    df = spark.createDataFrame([("Reactor-Temp maxValue", {"a": 1.0, "b": 2.0}, {"a": 3.0, "c": 1.0}, {"a": 0.5})], "n string, p map<string,double>, c map<string,double>, i map<string,double>")
    row = df.select(scalars.name_words(F.col("n")).alias("w"), scalars.slug(F.col("n")).alias("s"), scalars.role_of(F.col("n"), {"x": ("flow",), "sensor": ("temp",)}).alias("r"), scalars.mahalanobis(F.col("p"), F.col("c"), F.col("i")).alias("d"), scalars.mahalanobis(F.col("p"), F.create_map(F.lit("z"), F.lit(1.0)), F.col("i")).alias("none")).first()
    assert tuple(row) == (["reactor", "temp", "max", "value"], "reactor-temp-maxvalue", "sensor", 2.0, None)


def test_log_tables_and_upserts(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": 2}\nnot json\n{"k": 2}\n')
    assert sorted(tuple(r) for r in tables.log_table(spark, str(tmp_path / "log.jsonl"), "k int, v int").collect()) == [(1, 2), (2, None)]
    held = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 5.0)], "x string, y string, s double")
    new = spark.createDataFrame([("b", "a", 3.0), ("e", "f", 4.0)], "x string, y string, s double")
    assert [tuple(r) for r in tables.pair_upsert(held, new, "x", "y", "s", 2).collect()] == [("c", "d", 5.0), ("e", "f", 4.0)]


def test_change_points_name_their_method(spark):
    values = [(i, "a", float(i >= 100) * 5 + (i % 3) * 0.1) for i in range(200)]
    df = spark.createDataFrame(values, "t long, g string, v double")
    for rows, method in ((5000, "pelt"), (100, "cusum")):
        found = series.change_points(df, "t", "v", ["g"], "pelt", rows).collect()
        assert {r["method"] for r in found} == {method} and any(abs(r["place"] - 100) < 12 for r in found)


def test_clusters_by_a_plain_fold(spark):
    points = [(i, "g", [0.0, 9.0, 0.2, 9.3, 30.0][i % 5] + 0.01 * i) for i in range(25)]
    got = {r["i"]: r["cluster_id"] for r in clusters.cluster_rows(spark.createDataFrame(points, "i long, g string, v double"), "g", "i", ["v"]).collect()}
    held = []
    for i, _, v in points:
        near = [(w * (v - m) ** 2, k) for k, (m, w, _) in enumerate(held)]
        if near and min(near)[0] <= clusters.NEAR:
            k = min(near)[1]
            m, w, n = held[k]
            gap = v - m
            m += gap / (n + 1)
            held[k] = (m, (n + 1) / max(1e-9, n / max(1e-9, w) + gap * (v - m)), n + 1)
        else:
            k = len(held)
            held.append((v, 1.0, 1))
        assert got[i] == f"FC-{k + 1:03d}"


def _plain_clusters(values, near=clusters.NEAR):
    """How many clusters were founded before each value's, every cluster being asked."""
    held, out = [], []
    for x in values:
        found = clusters.match_or_create(held, {"v": x} if x is not None and x == x else {}, near)
        out.append(next(i for i, c in enumerate(held) if c is found))
    return out


def test_clusters_of_a_line_ask_few_of_them():
    draw = np.random.default_rng(3)
    usual = draw.exponential(50, 4000).round(2)
    cases = [usual, draw.normal(0, 1e4, 600), draw.normal(0, 0.5, 1500), np.where(draw.random(800) < 0.1, np.nan, draw.integers(0, 40, 800)), np.where(draw.random(800) < 0.1, np.inf, draw.integers(0, 40, 800) / 2)]
    cases += [draw.choice([1e16, 1e16 + 2, 1e16 + 4, -3e18, 1e100, 0.0], 300), np.cumsum(draw.normal(0, 1, 1500)) * np.linspace(1, 3, 1500)]
    for values in cases:
        for near in (0.0, 0.5, clusters.NEAR, 60.0):
            assert clusters.Line(near).numbers(values.tolist()) == _plain_clusters(values.tolist(), near)
    line = clusters.Line(clusters.NEAR)
    line.numbers(usual.tolist())
    asked = [len(line.cells.get(x // line.width, [])) + len(line.wide) for x in usual]
    assert len(line.n) > 80 and sum(asked) / len(asked) < 4


def test_clusters_by_keys_and_batches(spark):
    """Keys that end within batches, null and NaN keys, missing, infinite and very large values, several features."""
    draw = random.Random(5)
    value = lambda: draw.choice([None, float("nan"), float("inf"), 1e200, -1e200, *[draw.expovariate(0.05) for _ in range(20)]])
    rows = [(i, draw.choice([None, float("nan"), 1.0, 2.0, 3.0]), value(), draw.choice([None, 0.0, 9.0])) for i in range(1200)]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        df = spark.createDataFrame(rows, "i long, g double, v double, w double").repartition(3)
        got = {r["i"]: r["cluster_id"] for r in clusters.cluster_rows(df, "g", "i", ["v"]).collect()}
        both = {r["i"]: r["cluster_id"] for r in clusters.cluster_rows(df.where("abs(v) < 1e9"), "g", "i", ["v", "w"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for i, g, v, w in sorted(rows):
        groups.setdefault(str(g), []).append((i, v, w))
    for held in groups.values():
        # Beyond 1e150 squares overflow in a plain loop: one cluster for each such value.
        large = {x: -1e9 if x < 0 else 1e9 for x in (1e200, -1e200)}
        want = _plain_clusters([large.get(v, v) for _, v, _ in held])
        assert [got[i] for i, _, _ in held] == [clusters.numbered(k) for k in want]
        known = []
        for i, v, w in held:
            if v is not None and abs(v) < 1e9:
                assert both[i] == clusters.match_or_create(known, {"v": v} | ({"w": w} if w is not None else {})).cluster_id
    assert len(groups) == 5 and len(got) == 1200


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("then", ["id", "name"])
def test_running_sums_cut_frequent_values(spark, descending, then):
    """One value, or none, in nine tenths of the rows: sums are the loop's, and no range or part has many rows."""
    draw = random.Random(11)
    for usual in (7, None):
        rows = [(i, f"{draw.choice('abcdefgh')}{i:05d}", usual if i % 10 else draw.randint(0, 20), draw.randint(1, 5)) for i in range(3000)]
        df = spark.createDataFrame(rows, "id long, name string, v int, n int")
        got = {r["id"]: r["s"] for r in running.running(df, "v", {"s": F.col("n")}, then=[then], descending=descending, ties=True).collect()}
        place = lambda r: ((r[2] is not None, r[2] or 0) if not descending else (r[2] is None, -(r[2] or 0)), r[0 if then == "id" else 1])  # noqa: B023, E731
        total, want = 0, {}
        for r in sorted(rows, key=place):
            want[r[0]] = total
            total += r[3]
        assert got == want
        parts = running._in_parts(df, "v", then, running.RANGES, descending).groupBy("__range").count()
        assert parts.agg(F.max("count")).first()[0] <= 2 * 3000 / running.RANGES + 20 * (then == "id") + 25 * (then == "name")


def test_running_sums_by_text_and_of_awkward_orders(spark):
    rows = [(i, x) for i, x in enumerate(["", "a", "a\u0000", "ab", "zebra crossing", "zebra crosses", "é", None, "日本", "A"] * 7)]
    df = spark.createDataFrame(rows, "id long, v string")
    for ties in (False, True):
        got = {r["id"]: r["place"] for r in running.ranked(df, "v", then=["id"], ties=ties).collect()}
        want = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0]))
        assert [r[0] for r in want] == sorted(got, key=got.get)
        floats = spark.createDataFrame([(1, float("nan")), (2, float("nan")), (3, 0.0), (4, -0.0), (5, None), (6, 1.0)], "id long, v double")
        assert {r["id"]: r["place"] for r in running.ranked(floats, "v", then=["id"], ties=ties).collect()} == {5: 0, 3: 1, 4: 2, 6: 3, 1: 4, 2: 5}
        assert running.ranked(df.limit(0), "v", then=["id"], ties=ties).count() == 0
        assert [r["place"] for r in running.ranked(df.limit(3).withColumn("id", F.lit(None).cast("long")), "v", then=["id"], ties=ties).collect()]


@pytest.mark.parametrize("block", [8, 50, 65_536])
def test_sliding_windows_of_blocks(spark, monkeypatch, block):
    """Windows of a series cut into blocks are those of the whole series, with keys (hot), without, and of short series."""
    monkeypatch.setattr(series, "BLOCK", block)
    draw = random.Random(12)
    rows = [(t, g, None if draw.random() < 0.05 else draw.gauss(0, 1)) for g, n in (("a", 120), ("b", 30), ("c", 3), (None, 20)) for t in range(n)]
    df = spark.createDataFrame(rows, "t long, g string, v double").repartition(3)
    want = {}
    for g in ("a", "b", "c", None):
        known = [(t, v) for t, k, v in rows if k == g and v is not None]
        means = {known[i][0]: sum(v for _, v in known[i : i + 8]) / 8 for i in range(len(known) - 7)}
        want |= {(g, t): (m, abs(m - sum(means.values()) / len(means))) for t, m in means.items()}
    for hot in (False, True):
        got = {(r["g"], r["t"]): (r["window_mean"], r["distance"]) for r in series.moving_profile(df, "t", "v", ["g"], 8, hot).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    words = [sorted(map(str, series.sax_words(df, "t", "v", ["g"], 10, hot=hot).collect())) for hot in (False, True)]
    assert words[0] == words[1] and len(words[0]) > 20
    one = df.where("g = 'a'")
    assert sorted(r["distance"] for r in series.moving_profile(one, "t", "v", None, 8).collect()) == pytest.approx(sorted(want[k][1] for k in want if k[0] == "a"))
    assert sum(r["n"] for r in series.sax_words(one, "t", "v", [], 10).collect()) == one.where("v is not null").count() - 9
    assert series.moving_profile(df.limit(0), "t", "v").count() == 0 == series.sax_words(df.limit(0), "t", "v", []).count()


def test_words_of_means_that_lie_on_a_cut(spark):
    """Values of a few tenths, so that means of chunks are the series' but for rounding: sums run by time and then, however rows are dealt."""
    draw = random.Random(13)
    rows = [(t // 2, t, g, draw.randint(1, 9) / 10) for g in range(80) for t in range(40)]
    want = Counter()
    for g in range(80):
        values = [v for _, _, k, v in rows if k == g]
        mean = squares = 0.0
        for n, v in enumerate(values, 1):
            gap = v - mean
            mean += gap / n
            squares += gap * (gap - gap / n)
        z = [(v - sum_in_turn(values) / 40) / math.sqrt(squares / 39) for v in values]
        for i in range(40 - 15):
            means = [sum_in_turn(z[i + k : i + k + 2]) / 2 for k in range(0, 16, 2)]
            want["".join("ab"[m > 0] for m in means)] += 1
    draw.shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "t long, id long, g long, v double").repartition(parts)
        for time, then in (("id", []), ("t", ["id"])):
            got = series.sax_words(df, time, "v", ["g"], 16, 2, then=then) if then else series.sax_words(df, time, "v", ["g"], 16, 2)
            assert {r["word"]: r["n"] for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()} == want


def sum_in_turn(values):
    """Python's own sum compensates for rounding."""
    total = 0.0
    for v in values:
        total += v
    return total
