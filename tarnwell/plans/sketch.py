"""Sketches: a joined table condensed into layers, and the typed queries that these answer."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.control import models
from tarnwell.control.project import CAPABILITIES, cosine
from tarnwell.operators import clusters, profile, sampling, series, statistics, summaries
from tarnwell.sources.tables import read_texts, write_text

#: Gain from which a regime study asks for new bounds, and iterations between two such.
REGIME_GAIN, REGIME_REST = 0.3, 5
#: Columns of which pairs are looked at.
SHORTLIST = 20


def build_sketch(df: DataFrame, folder: str | Path, target: str | None = None, time: str | None = None, forbidden: tuple[str, ...] = (), key: list[str] | None = None, seed: int = 0, capability: str | None = None) -> Sketch:
    """A few batched jobs over the table; every layer is a small JSON file but the coreset, which is parquet."""
    folder = str(folder)
    df = df.cache()
    numbers = profile.numeric_columns(df)
    inputs = [c for c in numbers if c != target and c not in forbidden]
    l1 = [r.asDict(recursive=True) for r in profile.column_profile(df).collect()]
    tops = profile.top_values(df, [r["column"] for r in l1 if r["semantic"] == "categorical"]).collect() if any(r["semantic"] == "categorical" for r in l1) else []
    for row in l1:
        row["top"] = [[t["value"], t["n"]] for t in sorted(tops, key=lambda t: t["place"]) if t["column"] == row["column"]]
    # Pairs are of the columns that tell most of the target.
    telling = statistics.shortlist(df, inputs, target, SHORTLIST) if target in df.columns else inputs
    pairs = statistics.correlation_pairs(df, telling).collect() if len(telling) > 1 else []
    ranked = sorted(({"col_a": p["col_a"], "col_b": p["col_b"], "abs_corr": abs(p["corr"] or 0.0)} for p in pairs), key=lambda p: (-p["abs_corr"], p["col_a"], p["col_b"]))
    l2 = {"pairs": ranked[:10], "components": statistics.principal_components(df, inputs) if len(inputs) > 1 else []}
    l3 = {"bounds": [], "regimes": []}
    signal = target if target in numbers else next(iter(inputs), None)
    if time and signal:
        one = df.select(F.lit(0).alias("part"), time, signal)
        l3["bounds"] = [r["place"] for r in series.change_points(one, time, signal, ["part"]).orderBy("place").collect()]
        l3["regimes"] = [r.asDict() for r in series.regime_summary(df.where(F.col(signal).isNotNull()), time, signal, l3["bounds"]).orderBy("regime").collect()]
    if time and target in df.columns:
        if target in numbers:
            l3["targets"] = [r.asDict() for r in series.regime_summary(df.where(F.col(signal).isNotNull()), time, target, l3["bounds"]).orderBy("regime").collect()] if signal else []
        else:
            l3["targets"] = [r.asDict() for r in series.regime_classes(df, time, target, l3["bounds"]).orderBy("regime").collect()]
    # Without a capability, labels are classes and numbers weigh alike.
    kind = CAPABILITIES[capability].target_type if capability else "binary" if target not in numbers else ""
    weighed = sampling.weights_for(df, kind, target, time)
    sampling.weighted_sample(weighed, "weight", key or df.columns, seed=seed).write.mode("overwrite").parquet(f"{folder}/coreset")
    l5: dict[str, dict] = {}
    if time and numbers:
        long = df.select(time, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in inputs[:30]])).alias("p")).select(time, "p.*")
        for row in series.sax_words(long, time, "v", ["column"], hot=True).orderBy(F.desc("n"), "word").collect():
            l5.setdefault(row["column"], {"words": [], "motif": [], "discord": []})["words"].append([row["word"], row["n"]])
        for row in series.motifs_discords(long, time, "v", ["column"]).orderBy("column", "kind", "distance", "place").collect():
            l5.setdefault(row["column"], {"words": [], "motif": [], "discord": []})[row["kind"]].append([row["place"], row["match"], row["distance"]])
        l5 = {c: {**found, "words": found["words"][:8], "discord": found["discord"][::-1]} for c, found in l5.items()}
    l6 = statistics.dependence_graph(df, numbers)
    summaries.summaries(df).write.mode("overwrite").parquet(f"{folder}/summaries")
    layers = {"L1": l1, "L2": l2, "L3": l3, "L5": l5, "L6": l6, "L7": []}
    layers["similarity"] = similarity_vector(layers)
    matrix = statistics.correlation_matrix(df.dropna(subset=numbers), numbers) if len(numbers) > 1 else []
    layers["matrix"] = {"columns": numbers, "n": df.dropna(subset=numbers).count(), "values": [list(map(float, row)) for row in matrix]}
    layers["manifest"] = {"seed": seed, "target": target, "time": time, "n_columns": len(df.columns), "updated": 0}
    for name, value in layers.items():
        write_text(folder, f"{name}.json", json.dumps(value, default=str, sort_keys=True))
    df.unpersist()
    return Sketch(folder)


def similarity_vector(layers: dict) -> list[float]:
    """Twenty numbers: six of distributions, eight of joint structure, three of regimes, three of clusters."""
    l1, l2, l3, l7 = layers["L1"], layers["L2"], layers["L3"], layers["L7"]
    kinds = [sum(r["semantic"] == k for r in l1) / max(1, len(l1)) for k in ("numeric", "categorical", "datetime", "text")]
    missing = sum(r["n_missing"] / max(1, r["n_total"]) for r in l1) / max(1, len(l1))
    explained = [c["explained"] for c in l2["components"][:4]]
    pairs = [p["abs_corr"] for p in l2["pairs"][:4]]
    pad = lambda v, n: [*v, *[0.0] * n][:n]
    sizes = [float(r["n"]) for r in l3["regimes"]]
    failures = [float(c["n"]) for c in l7]
    return [*kinds, missing, float(len(l1)), *pad(explained, 4), *pad(pairs, 4), float(len(sizes)), min(sizes, default=0.0), max(sizes, default=0.0), float(len(l7)), sum(failures), max(failures, default=0.0)]


def residual_signature(verdict: str, gain: float, metric: float | None, n_features: int) -> dict[str, float]:
    """Five numbers by which failed experiments are alike; an unknown metric is 0."""
    return {"metric": metric if metric is not None and math.isfinite(metric) else 0.0, "gain": gain, "n_features": float(n_features), "warn": float(verdict == "WARN"), "fail": float(verdict == "FAIL")}


class Sketch:
    """Answers from the layers; a name that is not there gives {"error": ...}, never an exception."""

    def __init__(self, folder: str | Path):
        self.folder = str(folder)
        self.layers = {name: json.loads(text) for name, text in read_texts(self.folder, ".json").items()}

    def tools(self) -> list[str]:
        return ["quantile", "distribution", "cardinality", "missingness", "top_interactions", "conditional_dependence", "principal_components", "regimes", "regime_compare", "motifs", "discords", "causal_neighbors", "confounder_candidates", "failure_clusters", "match_residuals", "fit_quick", "cross_validate_quick"]

    def ask(self, tool: str, **arguments) -> dict:
        fn = getattr(self, f"_{tool}", None) if tool in self.tools() else None
        try:
            return fn(**arguments) if fn else {"error": f"unknown tool {tool}"}
        except (KeyError, IndexError, TypeError, ValueError) as error:
            return {"error": str(error)}

    def _write(self, name: str, value: object) -> None:
        self.layers[name] = value
        write_text(self.folder, f"{name}.json", json.dumps(value, default=str, sort_keys=True))

    def _column(self, column: str) -> dict:
        return next((r for r in self.layers["L1"] if r["column"] == column), None) or {"error": f"unknown column {column}"}

    def _distribution(self, column: str) -> dict:
        return self._column(column)

    def _quantile(self, column: str, q: float) -> dict:
        row = self._column(column)
        if not row.get("quantiles"):
            return {"error": row.get("error", f"{column} has no quantiles")}
        return {"column": column, "q": q, "value": float(np.interp(q, profile.QUANTILES, row["quantiles"]))}

    def _cardinality(self, column: str) -> dict:
        row = self._column(column)
        return row if "error" in row else {"column": column, "n_unique": row["n_unique"]}

    def _missingness(self, column: str | None = None) -> dict:
        rows = self.layers["L1"] if column is None else [self._column(column)]
        return rows[0] if "error" in rows[0] else {r["column"]: r["n_missing"] / max(1, r["n_total"]) for r in rows}

    def _top_interactions(self, top_k: int = 5) -> dict:
        return {"pairs": self.layers["L2"]["pairs"][:top_k]}

    def _principal_components(self, top_k: int = 5) -> dict:
        return {"components": self.layers["L2"]["components"][:top_k]}

    def _regimes(self) -> dict:
        return self.layers["L3"]

    def _regime_compare(self, a: int, b: int) -> dict:
        found = self.layers["L3"]["regimes"]
        if not (0 <= a < len(found) and 0 <= b < len(found)):
            return {"error": f"regimes are numbered 0 to {len(found) - 1}"}
        return {"a": found[a], "b": found[b], "mean_gap": found[b]["mean"] - found[a]["mean"]}

    def _motifs(self, column: str) -> dict:
        found = self.layers["L5"][column]
        return {"column": column, "words": found["words"], "motifs": found["motif"]}

    def _discords(self, column: str) -> dict:
        return {"column": column, "discords": self.layers["L5"][column]["discord"]}

    def _conditional_dependence(self, a: str, b: str, given: Sequence[str] = ()) -> dict:
        """The edge of the graph; with given, the partial correlation and its p-value as well."""
        edge = next((e for e in self.layers["L6"] if {e["src"], e["dst"]} == {a, b}), None)
        out = {"a": a, "b": b, "given": list(given), "dependent": edge is not None, "edge": edge}
        if given:
            held = self.layers["matrix"]
            at = [held["columns"].index(c) for c in (a, b, *given)]
            r = statistics.partial_correlation(np.array(held["values"]), at[0], at[1], tuple(at[2:]))
            p = statistics.fisher_p(r, held["n"], len(given))
            out |= {"partial_corr": r, "p": p, "dependent": p <= 0.05}
        return out

    def _causal_neighbors(self, node: str, top_k: int = 10) -> dict:
        found = sorted((e for e in self.layers["L6"] if node in (e["src"], e["dst"])), key=lambda e: -e["weight"])
        return {"node": node, "edges": found[:top_k]}

    def _confounder_candidates(self, treatment: str, outcome: str, top_k: int = 10) -> dict:
        near = lambda x: {n for e in self.layers["L6"] for n in (e["src"], e["dst"]) if x in (e["src"], e["dst"])} - {treatment, outcome}
        return {"candidates": sorted(near(treatment) & near(outcome))[:top_k]}

    def _failure_clusters(self, top_k: int = 10) -> dict:
        return {"clusters": sorted(self.layers["L7"], key=lambda c: -c["n"])[:top_k]}

    def _match_residuals(self, signature: dict[str, float]) -> dict:
        """The nearest failure cluster; nothing is changed."""
        known = [clusters.Cluster(**c) for c in self.layers["L7"]]
        found = [(d, c.cluster_id) for c in known if (d := c.distance(signature)) is not None]
        if not found:
            return {"matched": False, "best_cluster_id": None, "distance": None}
        distance, name = min(found)
        return {"matched": True, "best_cluster_id": name, "distance": distance}

    def _coreset(self, features: Sequence[str], target: str):
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{self.folder}/coreset")
        numbers = set(profile.numeric_columns(rows))
        usable = [c for c in features if c in numbers and c not in (target, "weight")]
        if target not in rows.columns:
            raise ValueError(f"target {target} is not in the coreset")
        if not usable:
            raise ValueError("no requested feature is in the coreset")
        return rows.withColumn("__row", F.xxhash64(*rows.columns)).dropDuplicates(["__row"]), usable

    def _fit_quick(self, capability: str, features: Sequence[str], target: str, seed: int = 0) -> dict:
        """The capability's usual model on four fifths of the coreset, by time if there is one, measured on the others."""
        rows, usable = self._coreset(features, target)
        time = self.layers["manifest"]["time"]
        kind = CAPABILITIES[capability]
        order = time if time in rows.columns else "__row"
        dealt = sampling.positional_split(rows.select("__row", *({order} - {"__row"})), order, "__row").select("__row", F.lit(0).alias("fold"), "role")
        valid, _ = models.train_and_validate(rows, models.Split(dealt, ["__row"], [0]), usable, target, kind.models[0], kind.metrics, seed, time)
        counts = {r["role"]: r["count"] for r in dealt.groupBy("role").count().collect()}
        return {"capability": capability, "features": usable, "metrics": valid, "n_train": counts.get("train", 0), "n_val": counts.get("valid", 0)}

    def _cross_validate_quick(self, capability: str, features: Sequence[str], target: str, seed: int = 0, n_splits: int = 3) -> dict:
        """The same by folds of the coreset."""
        rows, usable = self._coreset(features, target)
        kind = CAPABILITIES[capability]
        folded = rows.withColumn("__fold", sampling.hashed_fold(["__row"], n_splits, seed))
        found = models.cross_validate(folded, usable, target, kind.models[0], "__fold", kind.metrics, seed, self.layers["manifest"]["time"], ["__row"])
        return {"capability": capability, "features": usable, "metrics_mean": found, "n_splits": n_splits}

    def absorb(self, rows: DataFrame) -> None:
        """New rows join the profile: their summary is added, and the first layer's numbers are merged anew, no old row being read. Distinct values and quantiles are then estimates."""
        path = f"{self.folder}/summaries"
        summaries.summaries(rows).write.mode("append").parquet(path)
        merged = {r["column"]: r.asDict() for r in summaries.answers(rows.sparkSession.read.parquet(path)).collect()}
        self._write("L1", [{**row, **merged.get(row["column"], {})} for row in self.layers["L1"]])

    def update(self, iteration: int, verdict: str, area: str, gain: float, metric: float | None, features: Sequence[str], best: bool, last_regime: int = -100) -> dict:
        """What an experiment changes: a best pair joins the interactions, a gainful regime study asks for new bounds, a failure or warning joins or founds a cluster."""
        done: dict[str, object] = {}
        if area == "interactions" and best and len(features) > 1:
            a, b = sorted(features[:2])
            pairs = {tuple(sorted((p["col_a"], p["col_b"]))): p for p in self.layers["L2"]["pairs"]}
            pairs[a, b] = {"col_a": a, "col_b": b, "abs_corr": pairs.get((a, b), {}).get("abs_corr", 0.0), "mutual_info": max(0.0, gain)}
            self._write("L2", {**self.layers["L2"], "pairs": sorted(pairs.values(), key=lambda p: (-max(p.get("mutual_info", 0.0), p["abs_corr"]), p["col_a"], p["col_b"]))[:10]})
            done["L2"] = "interaction_promoted"
        if area == "regimes" and gain >= REGIME_GAIN and iteration - last_regime >= REGIME_REST:
            done["L3"] = "queued_for_resegmentation"
        if verdict in ("WARN", "FAIL"):
            known = [clusters.Cluster(**c) for c in self.layers["L7"]]
            before = len(known)
            cluster = clusters.match_or_create(known, residual_signature(verdict, gain, metric, len(features)))
            self._write("L7", [asdict(c) for c in known])
            done["L7"] = {"cluster_id": cluster.cluster_id, "created": len(known) > before}
        self._write("similarity", similarity_vector(self.layers))
        self._write("manifest", {**self.layers["manifest"], "updated": iteration})
        return done

    def likeness(self, other: Sketch) -> float:
        return cosine(self.layers["similarity"], other.layers["similarity"])
