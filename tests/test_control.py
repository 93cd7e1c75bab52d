"""Plans from questions to replay, sketch tools and updates, models by key, documents, servers, command line."""

import io
import json
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell import cli
from tarnwell.control import domains, estimators, execution, hypotheses, models, planning, reports, servers
from tarnwell.control.project import CAPABILITIES, Library, Mission, Project, literature_hits, projects_in
from tarnwell.operators import profile, sampling
from tarnwell.plans.sketch import build_sketch
from tarnwell.sources import tables


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(0)
    rows = []
    for i in range(600):
        x = float(draw.normal(100 if i < 300 else 105, 1))
        rows.append((i, i, x, float(draw.normal()), float(x > 102.5) + float(draw.normal(0, 0.01)), int(x > 102.5)))
    out = spark.createDataFrame(rows, "row long, t long, x_temp double, x_press double, downstream_qc double, y int").cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def sketch(spark, frame, tmp_path_factory):
    return build_sketch(frame, tmp_path_factory.mktemp("sketch") / "s", target="y", time="t", forbidden=("downstream_qc",), key=["row"])


def kind_of(key, *more):
    """A capability that measures its primary metric only, and more if named."""
    return replace(CAPABILITIES[key], metrics=(CAPABILITIES[key].primary, *more))


def mission(**more):
    return Mission(target="y", time="t", forbidden=("downstream_qc",), threshold=0.9, metric="roc_auc", **more)


def plan(**more):
    return execution.Plan(**{"id": "P-1", "model": "logreg", "features": ("x_temp", "x_press"), "family": "linear", "folds": 2} | more)


def test_plan_rules():
    p = plan()
    assert p.faults() == [] and p.faults([p.fingerprint]) == ["repeats a recent plan"]
    assert plan(id="7", features=(" ",)).faults() == ["id must start with P-", "features must not be empty"]
    assert len(p.faults(breakthrough=True)) == 2
    assert plan(evidence="domain_prior", reference="arxiv:1234.5678").faults(breakthrough=True) == []


def test_execution_records_and_replays(frame, tmp_path):
    project = Project(tmp_path / "p", mission())
    kind = kind_of("temporal_classification")
    good = execution.run_plan(project, frame, plan(iteration=10), kind, "row")
    assert good.value > 0.95 and good.verdict in ("ACCEPT", "WARN") and good.valid["roc_auc_pop"] > 0.95
    leak = execution.run_plan(project, frame, plan(id="P-2", features=("x_temp", "downstream_qc")), kind, "row")
    assert leak.verdict == "FAIL" and "leakage" in leak.reason
    probe = execution.execute(frame, plan(id="P-3", features=("x_temp", "+leak_canary"), area="leakage_probe"), project.mission, kind, "row")
    assert probe.value > 0.95
    assert execution.execute(frame, plan(model="tabnet"), project.mission, kind, "row").reason.startswith("KeyError")
    assert execution.execute(frame, plan(), Mission(target="y"), kind, "row").reason == "the task needs ['time']"
    report = execution.replay(project, frame, kind, "row")
    assert report["replayed"] == 2 and report["drift"][0]["abs_delta"] < 1e-6 and report["drift"][1]["abs_delta"] is None
    assert execution.replay(project, frame, kind, "row", upto=0)["replayed"] == 0


@pytest.mark.parametrize("key", ["tabular_classification", "tabular_regression", "anomaly_detection", "predictive_maintenance", "forecasting"])
def test_folds_and_models_of_capabilities(frame, key):
    kind = kind_of(key)
    target = "x_temp" if kind.target_type in ("continuous", "survival") else "y"
    told = Mission(target=target, time="t", group="g")
    rows = frame.withColumn("g", F.col("row") % 30)
    split = execution.folds_of(rows, kind, told, "row")
    roles = split.rows.groupBy("fold", "role").count().collect()
    assert {r["role"] for r in roles} == {"train", "valid"} and len({r["fold"] for r in roles}) == 5
    out = execution.execute(rows, plan(model=kind.models[0], features=("x_press", "downstream_qc")), told, kind, "row", population=False)
    assert out.reason == "" and out.value is not None and set(kind.metrics) <= set(out.valid)


def test_all_metrics_of_a_capability(frame):
    rows = frame.select(F.col("row").alias("id"), "y", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x_temp") - 97) / 11)).alias("p"))
    found = models.evaluated(rows, (*CAPABILITIES["temporal_classification"].metrics, "ibs", "unknown"))
    assert found["roc_auc"] == 1 and found["precision_at_top_pct_10"] == 1 and found["ibs"] is None is found["unknown"] and all(found[n] is not None for n in CAPABILITIES["temporal_classification"].metrics)


def test_every_key_fits(frame, monkeypatch):
    """Classifiers find the class, regressors the number, anomaly models the odd row, series models the level."""
    monkeypatch.setattr(models, "FOCAL_ROUNDS", 3)
    rows = models.prepared(frame, ["x_temp", "x_press"], "y").limit(400).cache()
    for key in ("logreg_l1", "ridge_classifier", "decision_tree", "extra_trees", "lgbm_weighted", "lgbm_focal", "mlp_tabular", "voting_soft", "stacked_blend", "bagging"):
        scored = models.build(key, ["x_temp", "x_press"], "y").fit(rows, "t", ["row"]).scored(rows)
        assert models.evaluated(scored.select(F.col("row").alias("id"), "y", "p"), ("roc_auc",))["roc_auc"] > 0.9, key
    for key in ("elasticnet", "extra_trees_regressor", "mlp_tabular_regressor", "lgbm_aft"):
        scored = models.build(key, ["y", "downstream_qc"], "x_temp").fit(frame, "t", ["row"]).scored(frame)
        assert models.evaluated(scored.select(F.col("row").alias("id"), F.col("x_temp").alias("y"), "p"), ("spearman",))["spearman"] > 0.6, key
    for key in ("isolation_forest", "lof", "ocsvm", "autoencoder_anomaly"):
        odd = rows.select("row", "x_temp", "x_press", "y").unionByName(rows.limit(1).selectExpr("-1L AS row", "300D AS x_temp", "-40D AS x_press", "y"))
        scored = models.build(key, ["x_temp", "x_press"], "y").fit(rows, "t", ["row"]).scored(odd)
        assert scored.orderBy(F.desc("p")).first()["row"] == -1, key
    assert models.available(CAPABILITIES["tabular_classification"].allowed) == CAPABILITIES["tabular_classification"].available()
    assert not set(models.UNAVAILABLE) & set(models.MODELS)


def test_series_models(spark):
    df = spark.createDataFrame([(i, float(10 + i % 7)) for i in range(70)], "t long, y double")
    later = spark.createDataFrame([(70 + i, 0.0) for i in range(10)], "t long, y double")
    got = [r["p"] for r in models.build("naive_seasonal", [], "y").fit(df, "t").scored(later).orderBy("t").collect()]
    assert got == [float(10 + (70 + i) % 7) for i in range(10)]
    line = np.arange(50.0)
    pattern, slope = estimators.theta(line)
    assert slope == pytest.approx(0.5) and 45 < pattern[0] < 52 and estimators.ets(np.full(9, 3.0)) == ([3.0], 0.0)


def test_focal_gradient_is_the_derivative():
    y, m = np.array([1.0, 0, 1, 0]), np.array([-2.0, -0.5, 0.3, 1.7])

    def loss(margin):
        p = 1 / (1 + np.exp(-margin))
        return np.where(y > 0, -0.25 * (1 - p) ** 2 * np.log(p), -0.75 * p**2 * np.log(1 - p))

    g, h = estimators.focal_gradient(y, m)
    assert g == pytest.approx((loss(m + 1e-5) - loss(m - 1e-5)) / 2e-5, abs=1e-6) and (h > 0).all()


def test_imputation_by_median(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("nan"), None), (None, None), (10.0, None)], "a double, b double")
    assert sorted(r["a"] for r in models.imputed(df, ["a", "b"]).collect()) == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert models.imputed(df, ["a", "b"]).agg(F.sum("b")).first()[0] == 0


def test_profiles_approximate_and_times(spark):
    df = spark.createDataFrame([(i, float(i), f"s{i % 3}", None) for i in range(1000)], "i long, x double, c string, n double").withColumn("ts", F.timestamp_seconds("i"))
    exact, rough = ({r["column"]: r for r in profile.column_profile(df, approximate=a).collect()} for a in (False, True))
    assert exact["ts"]["min"] == 0 and exact["ts"]["max"] == 999 and exact["x"]["quantiles"][3] == 499.5 and exact["n"]["quantiles"] is None
    assert exact["n"]["n_unique"] == 0 and exact["c"]["n_unique"] == 3 and exact["i"]["n_unique"] == 1000
    assert rough["i"]["n_unique"] == pytest.approx(1000, rel=0.05) and rough["x"]["quantiles"][3] == pytest.approx(499.5, abs=5)
    none = profile.column_profile(df.limit(0)).collect()
    assert len(none) == 5 and all(r["n_total"] == 0 and r["n_unique"] == 0 for r in none)


def test_sketch_tools(spark, sketch, frame):
    assert len(sketch.tools()) == 17
    assert "error" in sketch.ask("regime_compare", a=-1, b=0) and "error" in sketch.ask("regime_compare", a=0, b=99) and "mean_gap" in sketch.ask("regime_compare", a=0, b=1)
    assert len(sketch.ask("discords", column="x_press")["discords"]) == 3 and len(sketch.ask("motifs", column="x_press")["motifs"]) == 3 and "error" in sketch.ask("discords", column="zz")
    found = sketch.ask("conditional_dependence", a="x_temp", b="y", given=["x_press"])
    want = np.linalg.inv(np.corrcoef(np.array(frame.select("x_temp", "y", "x_press").collect(), float).T))
    assert found["dependent"] and found["partial_corr"] == pytest.approx(-want[0, 1] / np.sqrt(want[0, 0] * want[1, 1]), abs=1e-6)
    quick = sketch.ask("fit_quick", capability="temporal_classification", features=["x_temp", "weight", "zz"], target="y")
    assert quick["features"] == ["x_temp"] and quick["n_train"] == 480 and quick["n_val"] == 120
    crossed = sketch.ask("cross_validate_quick", capability="tabular_classification", features=["x_temp", "x_press"], target="y")
    assert crossed["metrics_mean"]["roc_auc"] > 0.95
    assert "error" in sketch.ask("fit_quick", capability="tabular_classification", features=["zz"], target="y") and "error" in sketch.ask("fit_quick", capability="tabular_classification", features=["x_temp"], target="zz")


def test_sketch_updates(sketch):
    assert sketch.ask("match_residuals", signature={"gain": 0.0}) == {"matched": False, "best_cluster_id": None, "distance": None}
    done = sketch.update(1, "FAIL", "interactions", 0.4, None, ["x_press", "x_temp"], best=True)
    assert done == {"L2": "interaction_promoted", "L7": {"cluster_id": "FC-001", "created": True}}
    assert sketch.update(2, "FAIL", "regimes", 0.4, None, ["x_press", "x_temp"], best=False) == {"L3": "queued_for_resegmentation", "L7": {"cluster_id": "FC-001", "created": False}}
    assert sketch.update(3, "ACCEPT", "regimes", 0.4, 0.8, [], best=False, last_regime=1) == {}
    again = type(sketch)(sketch.folder)
    assert again.ask("failure_clusters")["clusters"][0]["n"] == 2 and again.layers["manifest"]["updated"] == 3
    assert again.ask("match_residuals", signature={"gain": 0.4, "fail": 1.0})["best_cluster_id"] == "FC-001"
    assert [p["mutual_info"] for p in again.ask("top_interactions")["pairs"] if "mutual_info" in p] == [0.4] and again.layers["similarity"][17:] == [1.0, 2.0, 2.0]


def test_coreset_weights_follow_the_capability(spark, frame):
    rows = frame.select("row", "t", "x_temp", "y")
    spread = lambda df: df.agg(F.min("weight"), F.max("weight"), F.avg("weight")).first()
    low, high, mean = spread(sampling.weights_for(rows, CAPABILITIES["predictive_maintenance"].target_type, "y", "t"))
    assert high / low == pytest.approx(20) and mean == pytest.approx(1)
    assert sampling.weights_for(rows, "binary", "y").select("y", "weight").distinct().count() == 2
    assert sampling.weights_for(rows, "continuous", "x_temp").orderBy("weight").first()["x_temp"] == pytest.approx(rows.agg(F.percentile("x_temp", 0.5)).first()[0], abs=0.5)
    assert spread(sampling.weights_for(rows, "continuous", "none"))[:2] == spread(sampling.weights_for(rows, "survival", "y"))[:2] == (1.0, 1.0)


def test_sketch_absorbs_new_rows(spark, frame, tmp_path):
    sketch = build_sketch(frame.where("row < 400").select("row", "x_temp", "y"), tmp_path / "s", target="y")
    sketch.absorb(frame.where("row >= 400").select("row", "x_temp", "y"))
    again = type(sketch)(sketch.folder)
    row = again.ask("distribution", column="x_temp")
    mean, low = frame.agg(F.avg("x_temp"), F.min("x_temp")).first()
    assert (row["n_total"], row["min"], row["semantic"]) == (600, low, "numeric") and row["mean"] == pytest.approx(mean)
    assert again.ask("cardinality", column="row")["n_unique"] == pytest.approx(600, rel=0.03) and 99 < again.ask("quantile", column="x_temp", q=0.5)["value"] < 106


def test_hypotheses(sketch, tmp_path):
    project = Project(tmp_path / "p", mission(notes="Expected drivers:\nx_temp and x_press with x_flow, x_age\n\nOther things: none"))
    kind = CAPABILITIES["temporal_classification"]
    assert [h["id"] for h in hypotheses.generated(project, kind)] == [f"H-seed-{i}" for i in range(1, 6)]
    for i in range(6):
        project.record("linear", 0.5 + i / 100, area="features")
    project.direct("try `x_temp`", ["x_temp"])
    library = Library(tmp_path / "l.jsonl")
    library.add("q", [1.0], [{"gain": 0.4, "family": "tree", "model": "tabnet", "summary": "s"}, {"gain": 0.1}], kind.key)
    rows = hypotheses.generated(project, kind, sketch.layers, library)
    assert 8 <= len(rows) <= 12 and len({r["id"] for r in rows}) == len(rows)
    by = {r["source"]: r for r in rows}
    assert {"sketch", "user", "library", "directive"} <= set(by) and by["library"]["model"] == "lgbm_default" and by["user"]["features"]
    assert hypotheses.from_notes("nothing", ["x"], "linear", 1) == []


def test_planning_and_lock(spark, frame, tmp_path):
    report = profile.inspect_tables({"process": frame.select(F.col("row").alias("batch_id"), F.timestamp_seconds("t").alias("batch_time"), "x_temp"), "qa": frame.select(F.col("row").alias("batch_id"), "downstream_qc", F.col("y").alias("defect"))})
    recipe = planning.RECIPES["manufacturing_defect_classification"]
    found = planning.guesses(report, recipe)
    assert (found["target"], found["time"], found["group"], found["forbidden"]) == ("defect", "batch_time", "batch_id", ["downstream_qc"]) and found["joins"][0]["on"] == ["batch_id"]
    asked = planning.questions(report, recipe)
    assert [q.field for q in asked] == ["target", "time", "forbidden", "threshold", "joins"]
    told = planning.mission_of(asked, {"Q-5": 0.8, "Q-6": None}, recipe)
    assert (told.target, told.time, told.forbidden, told.threshold, told.metric, told.joins) == ("defect", "batch_time", ("downstream_qc",), 0.8, "roc_auc", ())
    project = planning.locked(tmp_path / "w" / "p", told, recipe.capability, recipe)
    seeds = tables.read_jsonl(project.folder / "hypotheses.jsonl")
    assert len(seeds) == 5 + 4 + 4 and len({s["id"] for s in seeds}) == len(seeds)
    assert project.status()["status"] == "planned" and json.loads((project.folder / "COLUMNS.json").read_text())["capability"] == "temporal_classification"
    with pytest.raises(ValueError):
        planning.locked(tmp_path / "w" / "q", Mission(target="y"), recipe.capability)
    (tmp_path / "r.json").write_text(json.dumps({"key": "mine", "split": "group", "unknown": 1}))
    assert planning.Recipe.load(tmp_path / "r.json").split == "group" and planning.read_json(tmp_path / "none.json") == {}


def test_reports(frame, tmp_path):
    project = Project(tmp_path / "p", mission())
    kind = kind_of("temporal_classification")
    with pytest.raises(ValueError):
        project.record("linear", 0.5)
        reports.write_final(project, kind)
    execution.run_plan(project, frame, plan(), kind, "row")
    effect = {"treatment": "x_temp", **models.treatment_effect(frame, "x_temp", "y", ["x_press"], resamples=3)}
    found = reports.write_final(project, kind, effect=effect, clusters=[{"cluster_id": "FC-001", "n": 2}])
    text = (project.folder / "FINAL.md").read_text()
    assert found["decision"].startswith("Adopt logreg") and "FC-001" in text and found["effect"]["effect"] > 0
    scaffold = reports.synthesis(project, kind)
    assert scaffold["best"] > 0.9 and "| linear |" in reports.synthesis_text(scaffold, "look")
    assert reports.directives_of("- try: `x_temp` alone\n- no\n* Avoid: lags")[0] == {"kind": "try", "text": "`x_temp` alone", "features": ["x_temp"]}
    library = Library(tmp_path / "library.jsonl")
    assert reports.extracted(project, kind, library, [1.0])["hypotheses"] == 2
    assert library.summary()["projects"] == 1 and "x_temp" not in json.dumps(library.rows)
    assert project.brief()["best"] > 0.9 and project.brief()["untried_arms"]


def test_domains():
    d = domains.domain("manufacturing")
    assert d.stage_of("reactor_temp") == "reaction" and d.forbidden_columns(["reactor_temp", "qc_a", "pack_n", "cure_time", "y"], "cure_time") == ["qc_a", "pack_n"]
    assert d.bounded(["x_temp", "flow_rate", "other"]) == {"x_temp": (-273.15, 2000.0), "flow_rate": (0.0, None)}
    assert domains.domain("unknown").key == "general" and len(domains.listing()) == 3


def test_domain_violations(frame):
    rows = {r["column"]: (r["n_below"], r["n_above"]) for r in domains.domain("manufacturing").violations(frame).collect()}
    assert rows["x_temp"] == (0, 0) and rows["x_press"][0] > 200


def test_servers(sketch, tmp_path):
    tools = servers.sketch_tools(sketch)
    out = io.StringIO()
    lines = ['{"name": "cardinality", "args": {"column": "y"}}', "", "not json", '{"jsonrpc": "2.0", "id": 3, "method": "tools/list"}', '{"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nope"}}']
    servers.serve(tools, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[0]["n_unique"] == 2 and "error" in got[1] and len(got[2]["result"]["tools"]) == 17 and "error" in got[3]["result"]
    library = Library(tmp_path / "l.jsonl")
    library.add("q", [1.0], [{"gain": 0.4}], "forecasting", failures=[{"cluster_id": "c", "n": 1}])
    retrieval = servers.retrieval_tools(library)
    assert servers.call(retrieval, "query_failures", {"capability": "forecasting"})[0]["n"] == 1 and servers.call(retrieval, "get_project", {"name": "q"})["project"] == "q" and len(retrieval) == 6
    budget = servers.budget_tools(Project(tmp_path / "p", Mission(target="y", token_cap=100)))
    assert servers.call(budget, "record", {"tokens": 40}) == {"total": 40} and servers.call(budget, "remaining") == {"tokens": 60} and servers.call(budget, "totals")["spent"] == 0.4
    assert "error" in servers.call(budget, "record", {"wrong": 1})


def test_command_line(tmp_path, capsys):
    run = lambda *a: (cli.main(["--workspace", str(tmp_path), *a]), json.loads(capsys.readouterr().out))[1]
    assert run("new-project", "p", "--target", "y", "--budget", "30", "--recipe", "process_anomaly")["project"] == "p"
    assert [r["project"] for r in run("list")] == ["p"] == [r["project"] for r in projects_in(tmp_path)]
    assert run("archive", "p")["status"] == "archived" and run("status", "p")["spent"] == 0
    assert run("library")["projects"] == 0 and len(run("domains")) == 3 and run("audit") == []
    told = json.loads((tmp_path / "p" / "MISSION.json").read_text())
    (tmp_path / "p" / "MISSION.json").write_text(json.dumps({k: v for k, v in told.items() if k != "notes"} | {"old": 1}))
    assert run("migrate", "p") == ["MISSION.json: notes", "MISSION.json: old"] + [f"STATE.json: {k}" for k in sorted(Project(tmp_path / "p").state.__dataclass_fields__)] and run("migrate", "p") == []
    assert run("extract", "p", "--capability", "anomaly_detection") == {"hypotheses": 0, "failures": 0} and run("library")["projects"] == 1
    (tmp_path / "p" / "BANDIT.json").write_text("{")
    assert run("audit")[0]["file"].endswith("BANDIT.json")


def test_inbox_and_literature(tmp_path):
    project = Project(tmp_path / "p", mission())
    project.direct("a")
    project.direct("b")
    assert [d["text"] for d in project.directives(consume=True)] == ["a", "b"] and project.directives() == []
    hits = literature_hits([{"title": "A", "year": "2020", "score": 1}, {"title": "a", "year": 2021}, {"title": "B", "year": 2021, "score": 2}, {"title": ""}])
    assert [(h["title"], h["year"]) for h in hits] == [("B", 2021), ("a", 2021)]


def test_documents_of_office_formats(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>é</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as archive:
        archive.writestr("word/document.xml", body)
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \b bold\b0  \u8364? {\i in}\par\{x\}}")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in tables.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("One\té\nTwo", None), "b.rtf": ("Café bold € in\n{x}", None), "c.docx": (None, "parser_failed:docx"), "d.pdf": (None, "parser_missing:pdf")}


def test_tables_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,NA\n2,x\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n')
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    found = tables.load_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in found.items()} == {"a": 2, "b": 1, "c": 3} and tables.load_tables(spark, str(tmp_path / "none")) == {}
    assert tables.write_joined(found["c"], str(tmp_path / "j")).count() == 3


def test_folds_of_few_rows(spark):
    df = spark.createDataFrame([(i, i) for i in range(3)], "id long, t long")
    assert sampling.time_folds(df, "t", "id").count() == 0
    assert sampling.positional_split(df, "t", "id").where("role = 'train'").count() == 2
