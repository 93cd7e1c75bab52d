"""Summaries that merge, and models that are fitted on all rows, against exact profiles and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.control import boosting, estimators, models
from tarnwell.operators import profile, summaries, survival


def test_summaries_merge(spark):
    draw = np.random.default_rng(1)
    rows = [(i % 7, float(x), int(k), f"s{k}", None if i % 9 == 0 else float(x) * 1e6) for i, (x, k) in enumerate(zip(draw.normal(3, 2, 6000), draw.integers(0, 900, 6000), strict=True))]
    df = spark.createDataFrame(rows, "part int, x double, k int, s string, y double").withColumn("at", F.timestamp_seconds("k")).withColumn("none", F.lit(None).cast("double"))
    parts = summaries.summaries(df, {"part": F.col("part")})
    assert parts.count() == 7 * 6
    whole = {r["column"]: r for r in summaries.answers(summaries.summaries(df.drop("part"))).collect()}
    halves = summaries.merged(parts.where("part < 3")).unionByName(summaries.merged(parts.where("part >= 3")))
    exact = {r["column"]: r for r in profile.column_profile(df.drop("part")).collect()}
    for found in (summaries.answers(parts), summaries.answers(halves)):
        for r in found.collect():
            want, one = exact[r["column"]], whole[r["column"]]
            assert [r[c] for c in ("n_total", "n_missing", "min", "max")] == [want[c] for c in ("n_total", "n_missing", "min", "max")]
            assert r["n_unique"] == pytest.approx(want["n_unique"], rel=0.025) and one["n_unique"] == pytest.approx(want["n_unique"], rel=0.025)
            assert (r["mean"], r["stdev"]) == (pytest.approx(want["mean"]), pytest.approx(want["stdev"])) if want["mean"] is not None else r["mean"] is None
            if want["mean"] is not None:
                values = np.sort([v for v in (row[r["column"]] for row in df.select(r["column"]).collect()) if v is not None])
                places = [np.searchsorted(values, [q, np.nextafter(q, np.inf)]) / len(values) for q in r["quantiles"]]
                assert all(low - 0.03 <= q <= high + 0.03 for q, (low, high) in zip(profile.QUANTILES, places, strict=True))
    assert {r["column"]: r["n_total"] for r in summaries.answers(summaries.summaries(df.limit(0))).collect()} == dict.fromkeys(df.columns, 0)


def test_cox_on_all_rows_is_the_loops(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 3))
    t = np.ceil(draw.exponential(np.exp(-x @ np.array([1.0, -0.5, 0.0]))) * 20) / 20  # with ties
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(t, x, strict=True)], "t double, a double, b double, c double").repartition(5)
    got = survival.cox_coefficients(df, ["a", "b", "c"], "t")
    assert got.tolist() == pytest.approx(estimators.cox_ph(t, x).tolist(), abs=1e-6)
    fitted = models.build("cox_ph", ["a", "b", "c"], "t").fit(df)
    scored = fitted.scored(df).orderBy("t").select("p").collect()
    assert np.mean([r["p"] for r in scored[:100]]) > np.mean([r["p"] for r in scored[-100:]])
    # Rows whose end was not seen are in risk sets only.
    seen = df.withColumn("seen", (F.col("t") < 1.0).cast("int"))
    some = survival.cox_coefficients(seen, ["a", "b", "c"], "t", "seen")
    beta = np.zeros(3)
    for _ in range(25):
        w = np.exp(x @ beta)
        gradient, matrix = -survival.RIDGE * beta, survival.RIDGE * np.eye(3)
        for i in np.flatnonzero(t < 1.0):
            risk = t >= t[i]
            mean = (w[risk, None] * x[risk]).sum(0) / w[risk].sum()
            gradient = gradient + x[i] - mean
            matrix = matrix + (w[risk, None, None] * x[risk, :, None] * x[risk, None, :]).sum(0) / w[risk].sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(matrix, gradient)
    assert some.tolist() == pytest.approx(beta.tolist(), abs=1e-6)
    assert survival.cox_coefficients(df.limit(0), ["a"], "t").tolist() == [0.0]


def test_boosting_on_all_rows_grows_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    draw = np.random.default_rng(3)
    x = np.column_stack([draw.normal(size=500), draw.integers(0, 5, 500), draw.normal(size=500)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2)).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(4)
    plain = estimators.FocalBoosting(rounds=5).fit(x, y)
    model = boosting.BoostedOnAllRows(rounds=5).fit(df, ["a", "b", "c"], "y")
    assert model.predict(x).tolist() == pytest.approx(plain.predict(x).tolist(), abs=1e-9)
    scored = df.withColumn("p", model.column(["a", "b", "c"])).collect()
    assert np.mean([(r["p"] > np.median([s["p"] for s in scored])) == (r["y"] > 0) for r in scored]) > 0.8
    # Another loss: squares.
    squares = boosting.BoostedOnAllRows(lambda target, margin: (margin - target, np.ones(len(target))), rounds=1, rate=1.0, depth=1, ridge=0.0).fit(df, ["b"], "y")
    tree = squares.trees[0]
    assert len(tree.values) == 2 and list(tree.splits) == [0]


def test_ridge_has_the_usual_strength(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(30, 2)) * [1.0, 5.0]
    y = x @ [2.0, -1.0] + 3 + draw.normal(size=30)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    got = [r["p"] for r in models.build("ridge", ["a", "b"], "y").fit(df).scored(df).collect()]
    centred = x - x.mean(axis=0)
    beta = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (y - y.mean()))
    assert got == pytest.approx((y.mean() + centred @ beta).tolist(), abs=1e-6)
