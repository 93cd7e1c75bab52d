"""Hand-computed values, edge cases, the feature language, sketches and the control plane."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.control import models
from tarnwell.control.project import CAPABILITIES, Library, Mission, Project, audit, capability_for, fingerprint
from tarnwell.operators import clusters, joins, metrics, profile, sampling, series, statistics
from tarnwell.plans.features import Context, expand
from tarnwell.plans.sketch import build_sketch
from tarnwell.sources import tables


def scored(spark, y, p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y double, p double")


def one(df):
    return df.first()[0]


def test_metrics_by_hand(spark):
    top = scored(spark, [1.0] * 4 + [0.0] * 6, [0.9, 0.8, 0.4, 0.3, 0.7, 0.6, 0.2, 0.1, 0.05, 0.0])
    row = metrics.top_percent(top, (20,)).first()
    assert (row["recall"], row["precision"], row["lift"]) == (0.5, 1.0, 2.5)
    assert 0 <= one(metrics.ece(scored(spark, [1.0, 0, 1, 0, 1], [0.9, 0.1, 0.8, 0.2, 0.7]))) <= 1
    assert one(metrics.ece(scored(spark, [1.0, 0], [1.5, -0.1]))) is None
    assert one(metrics.roc_auc(scored(spark, [0.0, 1, 0, 1, 1, 0], [0.1, 0.9, 0.2, 0.8, 0.6, 0.3]))) > 0.9
    assert one(metrics.ndcg(scored(spark, [3.0, 2, 1, 0], [0.9, 0.8, 0.5, 0.1]))) == pytest.approx(1)
    assert one(metrics.concordance(scored(spark, [1.0, 2, 3], [0.9, 0.5, 0.1]))) == 1
    plain = metrics.plain(scored(spark, [1.0, 2, 3, 4], [1.1, 1.9, 2.9, 4.0]), ["rmse", "r2"]).first()
    assert plain["rmse"] < 0.2 and plain["r2"] > 0.9
    assert one(metrics.roc_auc(scored(spark, [1.0, 1], [0.2, 0.4]))) is None


def test_metrics_of_nothing(spark):
    none = scored(spark, [], [])
    assert metrics.plain(none, ["rmse", "mae", "r2"]).first().asDict() == {"rmse": None, "mae": None, "r2": None}
    for fn in (metrics.roc_auc, metrics.average_precision, metrics.ece, metrics.ndcg, metrics.concordance):
        assert one(fn(none)) is None


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert joins.equi_join(a, b, ["k"], "inner", "b").columns == ["k", "v", "v_b"]
    counts = {how: joins.equi_join(a, b, ["k"], how, "b").count() for how in ("inner", "left", "right", "outer")}
    assert counts == {"inner": 2, "left": 3, "right": 2, "outer": 3}
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("u", 2, 10), ("u", 5, 20), (None, 3, 30), ("u", None, 40)], "k string, t int, w int")
    got = {(r["k"], r["t"]): r["w"] for r in joins.asof_join(left, right, "t", ["k"]).collect()}
    assert got == {("u", 5): 20, ("u", 1): None, ("v", 9): None, (None, 3): 30}
    with pytest.raises(ValueError):
        joins.run_plan({"a": a, "b": b}, [])


def test_names():
    assert all(profile.looks_like_id(n) for n in ("id", "SerialNumber", "batch_id", "user-key", "Lot Code", "part_123456", "x_run_idx"))
    assert not any(profile.looks_like_id(n) for n in ("width", "paid", "temperature", "grid", "part_123"))


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, True, "a"), (float("nan"), None, False, None)], "x double, y double, b boolean, s string")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (rows["x"]["n_missing"], rows["x"]["mean"], rows["x"]["stdev"]) == (1, 1.0, 0.0)
    assert rows["y"]["n_unique"] == 0 and rows["b"]["semantic"] == "boolean" and rows["s"]["semantic"] == "categorical"
    assert profile.column_profile(df.where("false")).count() == 4


def test_statistics():
    draw = np.random.default_rng(0)
    a, b = draw.normal(0, 1, 60), draw.normal(0, 3, 60)
    assert statistics.f_test_p(a.var(ddof=1), 60, b.var(ddof=1), 60) < 1e-6 < 0.3 < statistics.f_test_p(1.0, 60, 1.02, 60)
    x = (np.arange(200_000) + 0.5) / 200_000 * 0.25  # the density of F(5, 7) below 1 / 4
    beta = math.lgamma(2.5) + math.lgamma(3.5) - math.lgamma(6)
    density = np.exp(2.5 * np.log(5 * x) + 3.5 * math.log(7) - 6 * np.log(5 * x + 7) - np.log(x) - beta)
    assert statistics.f_test_p(1.0, 6, 4.0, 8) == pytest.approx(2 * density.mean() * 0.25, abs=1e-4)
    assert statistics.ks_p(0.5, 100, 100) < 1e-6 and statistics.ks_p(0.05, 100, 100) > 0.9 and statistics.ks_p(1, 3, 3) == 1
    assert statistics.fisher_p(0.0, 100, 0) == 1 and statistics.fisher_p(0.9, 100, 1) < 1e-9


def test_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "a double, c double")
    assert statistics.correlation_pairs(df, ["a", "c"]).first()["corr"] is None


def test_series():
    values = np.r_[np.zeros(300), np.ones(300) * 5] + np.random.default_rng(1).normal(0, 1, 600)
    assert any(abs(p - 300) < 40 for p in series.cusum(values)) and any(abs(p - 300) < 5 for p in series.pelt_rbf(values))
    assert series.cusum(np.zeros(50)) == [] and series.regime_bounds([10, 100, 590], 600) == [100]
    wave = np.sin(np.arange(256) * 2 * np.pi / 32) + np.random.default_rng(2).normal(0, 0.01, 256)
    distance, place = series.matrix_profile(wave, 32)
    assert distance.max() < 1 and (np.abs(place - np.arange(len(place))) > 8).all()


def test_clusters():
    found = []
    ids = [clusters.match_or_create(found, p).cluster_id for p in ({"a": 1.0, "b": 2.0}, {"a": 1.05, "b": 2.05}, {"a": 100.0, "b": -100.0}, {"z": 1.0})]
    assert ids == ["FC-001", "FC-001", "FC-002", "FC-003"]


def test_sample_is_deterministic(spark):
    df = spark.range(2000).withColumn("weight", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    rows = [sampling.weighted_sample(df.repartition(n), "weight", ["id"], 300).collect() for n in (2, 7)]
    assert {r["id"] for r in rows[0]} == {r["id"] for r in rows[1]} and len(rows[0]) == 300
    assert sum(r["id"] % 2 == 0 for r in rows[0]) > 180 and sum(r["weight"] for r in rows[0]) == pytest.approx(300)


def test_features_and_leaks(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), i % 24, "xyz"[i % 3], i % 2, float(i)) for i in range(50)], "a double, b double, hour int, category string, target int, leak double")
    context = Context(target="target", forbidden=("leak",), interactions=(("a", "b"), ("a", "leak")))
    out = expand(df, ["+all_allowed", "engineered:ratios", "engineered:interactions_top5", "engineered:cyclic", "engineered:polynomial_2", "engineered:frequency_encoding", "engineered:binning_quantile_4", "engineered:unknown", "nothing"], context)
    assert {"X__a_div_b", "X__a_x_b", "X__hour_sin", "X__hour_cos", "X__a_sq", "X__category_freq", "X__a_qbin4"} <= set(out.columns)
    assert not out.leaks(context) and not any("leak" in c or "target" in c for c in out.columns) and out.frame.count() == 50
    assert expand(df, ["+leak_canary"], context).leaks(context) == ["leak"]
    with pytest.raises(ValueError):
        expand(df, ["engineered:lag_1"], context)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n2,b\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "c.json").write_text('[{"k": 1}]')
    (tmp_path / "n.txt").write_text("hello é")
    (tmp_path / "r.pdf").write_bytes(b"%PDF")
    found = tables.load_tables(spark, str(tmp_path))
    assert sorted(found) == ["a", "b", "c"] and found["a"].where("y is null").count() == 1
    docs = {r["suffix"]: r for r in tables.documents(spark, [str(tmp_path / "n.txt"), str(tmp_path / "r.pdf")]).collect()}
    assert docs[".txt"]["text"] == "hello é" and docs[".pdf"]["error"] == "parser_missing:pdf"
    with pytest.raises(ValueError):
        tables.read_one(spark, "x.xml")
    report = profile.inspect_tables(found)
    assert not report["errors"] and set(report["tables"]) == {"a", "b", "c"}


def test_documents_are_whole_unless_limited(spark, tmp_path):
    text = "ab" * tables.DOCUMENT_LIMIT
    (tmp_path / "long.txt").write_text(text)
    row = tables.documents(spark, str(tmp_path / "long.txt")).first()
    assert row["text"] == text and row["n_chars"] == len(text) and row["truncated"] is False
    row = tables.documents(spark, str(tmp_path / "long.txt"), tables.DOCUMENT_LIMIT).first()
    assert row["text"] == text[: tables.DOCUMENT_LIMIT] and row["n_chars"] == len(text) and row["truncated"] is True


def test_project(tmp_path):
    project = Project(tmp_path / "p", Mission(target="y", threshold=0.9, stagnation_window=2, iteration_cap=20, token_cap=1000, floor=0.8))
    project.record("linear", 0.6, plan="a", tokens=120)
    project.record("linear", float("nan"), "FAIL", ["finite_metric"], plan="b", tokens=230)
    assert project.spent() == pytest.approx(0.35) and project.stop_reasons() == []
    for family in ("tree", "boosting", "neural"):
        project.record(family, 0.6, plan="b")
    assert project.stop_reasons() == ["escalation_required"] and not project.halted()
    assert project.looping()
    project.record("ensemble", 0.95)
    assert "goal_met" in project.stop_reasons() and project.recommendation()["best"]["family"] == "ensemble"
    again = Project(tmp_path / "p")
    assert again.state == project.state and 0 < again.arms()["linear"] < 1 and again.pick(1) in again.arms()
    assert fingerprint("m", "f", "a", ["y", "x"]) == fingerprint("m", "f", "a", ["x", "y"])
    mission = Mission(target="y", forbidden=("q",))
    assert audit(["X__y_sq", "a", "q"], mission, {"X__y_sq": {"y"}}) == ["X__y_sq", "q"]
    assert capability_for("binary", "time", "time").key == "temporal_classification" and len(CAPABILITIES) == 7
    with pytest.raises(ValueError):
        Mission(target="y", forbidden=("y",))
    library = Library(tmp_path / "library.jsonl")
    library.add("p", [1.0, 0.0], [{"gain": 0.4}], "forecasting")
    library.add("p", [0.0, 1.0], [{"gain": 0.2}], "forecasting")
    assert library.similar([0.0, 1.0]) == [("p", pytest.approx(1.0))] and library.hypotheses("forecasting") == [{"gain": 0.2}]


def test_check_metrics():
    assert metrics.check_metrics({"roc_auc": 0.8}, primary="roc_auc")["verdict"] == "ACCEPT"
    assert metrics.check_metrics({"roc_auc": math.nan}, primary="roc_auc")["verdict"] == "FAIL"
    assert metrics.check_metrics({"roc_auc": 0.995}, n_features=3, primary="roc_auc")["verdict"] == "WARN"


def _frame(spark):
    draw = np.random.default_rng(0)
    rows = [(i, float(x := draw.normal(100 if i < 300 else 105, 1)), float(draw.normal()), "ABC"[i % 3], int(x > 102.5)) for i in range(600)]
    return spark.createDataFrame(rows, "t long, x_temp double, x_press double, cat string, y int")


def test_sketch(spark, tmp_path):
    sketch = build_sketch(_frame(spark), tmp_path / "s", target="y", time="t", key=["t"])
    assert abs(sketch.ask("quantile", column="x_press", q=0.5)["value"]) < 0.3
    assert sketch.ask("cardinality", column="cat")["n_unique"] == 3 and "error" in sketch.ask("cardinality", column="zz") and "error" in sketch.ask("no_tool")
    assert len(sketch.ask("regimes")["regimes"]) >= 2 and len(sketch.layers["similarity"]) == 20
    assert sketch.ask("conditional_dependence", a="x_temp", b="y")["dependent"] and sketch.likeness(sketch) == pytest.approx(1)
    assert spark.read.parquet(str(tmp_path / "s" / "coreset")).count() == 600


def test_models(spark):
    df = _frame(spark).withColumn("fold", sampling.hashed_fold(["t"], 3))
    assert models.cross_validate(df, ["x_temp", "x_press"], "y", "logreg", "fold", ("roc_auc",))["roc_auc"] > 0.95
    effect = models.treatment_effect(df, "x_temp", "y", ["x_press"], resamples=5)
    assert effect["low"] <= effect["effect"] * 1.2 and effect["effect"] > 0
    with pytest.raises(KeyError):
        models.build("tabnet", ["x"], "y")
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 2))
    beta = models.cox_ph(draw.exponential(np.exp(-x @ np.array([1.0, -0.5]))), x)
    assert beta == pytest.approx([1.0, -0.5], abs=0.25)
    scores = models.isolation_scores(x)(np.array([[0.0, 0.0], [8.0, 8.0]]))
    assert scores[1] > scores[0]


def test_entry_works(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) >= 70 and set(entry.oracle_sql()) <= set(names)
