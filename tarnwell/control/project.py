"""Projects: task description, capabilities, run log, budget, bandit, stopping and loop rules.

All of it is small state on the driver, kept as JSON files that are replaced whole or
appended to. Analytics over collected logs are ordinary queries (``log_table``).
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np

from tarnwell.sources.tables import append_jsonl, read_jsonl

#: Technique families and events of the ledger (fixed values).
FAMILIES = ("linear", "tree", "boosted_tree", "neural", "ensemble", "rule_based", "survival", "anomaly", "forecasting_classical", "forecasting_neural")
LEAST_FAMILIES = 4


@dataclass(frozen=True)
class Capability:
    """A kind of task: its composition, splitter, metrics and models."""

    key: str
    target_type: str
    temporal: str
    split: str
    metrics: tuple[str, ...]
    primary: str
    higher_is_better: bool
    models: tuple[str, ...]
    required: tuple[str, ...] = ("target",)
    allowed: tuple[str, ...] = ()

    @property
    def signature(self) -> str:
        return f"{self.target_type}|{self.temporal}|{self.split}"

    def lacking(self, mission: Mission) -> list[str]:
        """Required fields that the mission leaves empty."""
        return [name for name in self.required if not getattr(mission, name, None)]

    def available(self) -> list[str]:
        """The allowed models that build here."""
        from tarnwell.control import models

        return models.available(self.allowed)


#: Metrics, primary metrics and allowed models of each capability (fixed values).
_CLASS = ("roc_auc", "average_precision", "log_loss", "brier", "expected_calibration_error", "recall_at_top_pct_10", "precision_at_top_pct_10", "lift_at_top_pct_10")
_BOOSTED = ("lgbm_binary", "xgboost_binary", "catboost_binary", "lgbm_focal", "lgbm_weighted", "xgboost_focal")
_BLENDS = ("voting_soft", "bagging", "stacked_blend")
CAPABILITIES = {
    c.key: c
    for c in (
        Capability("tabular_classification", "binary", "none", "stratified", _CLASS, "roc_auc", True, ("logreg", "lgbm_binary"), allowed=("logreg", "ridge_classifier", "elasticnet", "logreg_l1", "logreg_elastic", *_BOOSTED, "decision_tree", "extra_trees", "random_forest", *_BLENDS, "mlp_tabular", "ft_transformer", "tabnet")),
        Capability("tabular_regression", "continuous", "none", "group", ("rmse", "mae", "r2", "mape"), "rmse", False, ("ridge", "lgbm_regressor"), allowed=("ridge", "elasticnet", "lgbm_regressor", "xgboost_regressor", "catboost_regressor", "extra_trees_regressor", "random_forest_regressor", "mlp_tabular_regressor")),
        Capability("temporal_classification", "binary", "time", "time", _CLASS, "roc_auc", True, ("lgbm_binary", "logreg"), ("target", "time"), ("logreg", "ridge_classifier", "logreg_l1", *_BOOSTED, "extra_trees", "random_forest", *_BLENDS, "mlp_tabular")),
        Capability("forecasting", "continuous", "time", "rolling", ("mape", "rmse", "smape"), "mape", False, ("naive_seasonal", "ridge_lagged", "lgbm_regressor"), ("target", "time"), ("naive_seasonal", "ridge_lagged", "prophet", "theta", "ets", "lgbm_regressor", "xgboost_regressor")),
        Capability("predictive_maintenance", "survival", "time", "group", ("concordance_index",), "concordance_index", True, ("cox_ph", "lgbm_survival"), ("target",), ("cox_ph", "lgbm_survival", "lgbm_aft", "random_survival_forest")),
        Capability("anomaly_detection", "binary", "none", "stratified", ("roc_auc", "average_precision", "precision_at_k", "recall_at_top_pct_5", "precision_at_top_pct_5", "lift_at_top_pct_5"), "average_precision", True, ("isolation_forest", "ocsvm", "lof"), allowed=("isolation_forest", "ocsvm", "lof", "autoencoder_anomaly", "lgbm_binary", "xgboost_binary")),
        Capability("root_cause_attribution", "binary", "none", "stratified", ("roc_auc", "ndcg_at_10", "spearman_rank_corr"), "ndcg_at_10", True, ("lgbm_binary", "logreg"), allowed=("lgbm_binary", "xgboost_binary", "logreg", "permutation_importance")),
    )
}


def capability_for(target_type: str, temporal: str, split: str) -> Capability:
    """The first capability of this composition, else of this target type and temporal structure."""
    for exact in (True, False):
        for c in CAPABILITIES.values():
            if (c.target_type, c.temporal) == (target_type, temporal) and (c.split == split or not exact):
                return c
    raise KeyError(f"no capability for {target_type}|{temporal}|{split}")


@dataclass
class Mission:
    """What to predict, under which rules, when to stop. Checked when made."""

    target: str
    time: str | None = None
    group: str | None = None
    forbidden: tuple[str, ...] = ()
    threshold: float = 1.0
    higher_is_better: bool = True
    iteration_cap: int = 50
    token_cap: int = 1_000_000
    stagnation_window: int = 12
    failure_window: int = 3
    floor: float | None = None
    breakthrough_window: int = 6
    breakthroughs: int = 2
    metric: str | None = None
    notes: str = ""
    domain: str = "general"
    joins: tuple = ()

    def __post_init__(self) -> None:
        if not self.target or self.target in self.forbidden:
            raise ValueError("the target must be named and not be forbidden")
        if self.iteration_cap < 1 or self.token_cap < 1:
            raise ValueError("caps must be positive")


def fingerprint(model: str, family: str, area: str, features: Iterable[str]) -> str:
    """Ten digits that equal plans share."""
    return hashlib.sha1("|".join([model, family, area, ",".join(sorted(features))]).encode()).hexdigest()[:10]


def audit(features: Iterable[str], mission: Mission, lineage: dict[str, set[str]] | None = None, area: str = "") -> list[str]:
    """Features that reach the target or, but for a leakage probe, a forbidden column; by lineage, so engineered columns count too."""
    lineage = lineage or {}
    bad = {mission.target} | (set() if area == "leakage_probe" else set(mission.forbidden))
    return [f for f in features if (lineage.get(f, {f}) | {f}) & bad]


@dataclass
class State:
    iteration: int = 0
    best: float | None = None
    since_improvement: int = 0
    breakthrough: bool = False
    in_breakthrough: int = 0
    entries: int = 0


class Project:
    """A folder with a mission, a state, and logs of experiments, plans and spending."""

    def __init__(self, folder: str | Path, mission: Mission | None = None):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        if mission is not None:
            self._replace("MISSION.json", asdict(mission))
        self.mission = Mission(**{k: tuple(v) if isinstance(v, list) else v for k, v in self._load("MISSION.json").items() if k in Mission.__dataclass_fields__})
        self.state = State(**{k: v for k, v in self._load("STATE.json").items() if k in State.__dataclass_fields__})

    def migrate(self) -> list[str]:
        """Rewrite mission and state in the present form; the fields that were left out or added."""
        changed = []
        for name, value in (("MISSION.json", asdict(self.mission)), ("STATE.json", asdict(self.state))):
            changed += [f"{name}: {k}" for k in sorted(set(self._load(name)) ^ set(value))]
            self._replace(name, value)
        return changed

    def _load(self, name: str) -> dict:
        path = self.folder / name
        return json.loads(path.read_text()) if path.exists() else {}

    def write(self, name: str, value: dict) -> None:
        """Put a JSON file in the folder, whole or not at all."""
        self._replace(name, value)

    def _replace(self, name: str, value: dict) -> None:
        part = self.folder / f".{name}.part"
        part.write_text(json.dumps(value, indent=1, sort_keys=True))
        os.replace(part, self.folder / name)

    def experiments(self) -> list[dict]:
        return read_jsonl(self.folder / "experiments.jsonl")

    def recent_plans(self) -> list[str]:
        """Fingerprints of the last ten plans, the oldest first."""
        return self._load("PLANS.json").get("recent", [])

    def untried(self) -> list[str]:
        """Families without an experiment."""
        tried = {r["family"] for r in self.experiments()}
        return [f for f in FAMILIES if f not in tried]

    def direct(self, text: str, features: Iterable[str] = ()) -> dict:
        """Leave a message for the next iteration."""
        row = {"sequence": len(read_jsonl(self.folder / "inbox.jsonl")) + 1, "text": text, "features": list(features), "iteration": self.state.iteration}
        append_jsonl(self.folder / "inbox.jsonl", row)
        return row

    def directives(self, consume: bool = False) -> list[dict]:
        """Messages that no iteration has taken yet."""
        done = self._load("INBOX.json").get("consumed", 0)
        rows = [r for r in read_jsonl(self.folder / "inbox.jsonl") if r.get("sequence", 0) > done]
        if consume and rows:
            self._replace("INBOX.json", {"consumed": rows[-1]["sequence"]})
        return rows

    def brief(self, k: int = 5) -> dict:
        """What the next iteration should know."""
        from tarnwell.control.domains import domain

        rows = self.experiments()
        arms = self.arms()
        return {
            "iteration": self.state.iteration + 1,
            "mission": asdict(self.mission),
            "best": self.state.best,
            "since_improvement": self.state.since_improvement,
            "breakthrough": self.state.breakthrough,
            "recent": [{key: r.get(key) for key in ("iteration", "family", "metric", "verdict")} for r in rows[-k:]],
            "recent_plans": self.recent_plans(),
            "looping": self.looping(),
            "top_arms": sorted(arms, key=lambda f: (-arms[f], f))[:3],
            "untried_arms": self.untried(),
            "budget_spent": self.spent(),
            "directives": self.directives(),
            "domain": domain(self.mission.domain).brief(self.mission.target),
            "stop_reasons": self.stop_reasons(),
        }

    def status(self) -> dict:
        return {"project": self.folder.name, "iteration": self.state.iteration, "best": self.state.best, "status": self._load("STATUS.json").get("status", "open"), "confidence": self.recommendation()["confidence"], "domain": self.mission.domain, "spent": self.spent()}

    def archive(self) -> None:
        """Mark as finished; nothing is removed."""
        self._replace("STATUS.json", {"status": "archived"})

    def better(self, a: float, b: float | None) -> bool:
        return b is None or (a > b if self.mission.higher_is_better else a < b)

    def record(self, family: str, metric: float | None, verdict: str = "ACCEPT", failed: Iterable[str] = (), plan: str = "", tokens: int = 0, outcome: dict | None = None, area: str = "") -> dict:
        """Append an experiment and update state, bandit, spending and the ring of plans. Its information gain is at most 1."""
        s = self.state
        s.iteration += 1
        value = metric if metric is not None and math.isfinite(metric) else None
        gain = min(1.0, 5 * abs(value - (s.best or 0.0))) if value is not None else 0.0
        improved = value is not None and verdict != "FAIL" and self.better(value, s.best)
        if improved:
            s.best, s.since_improvement = value, 0
        else:
            s.since_improvement += 1
        s.in_breakthrough = 0 if improved or not s.breakthrough else s.in_breakthrough + 1
        s.breakthrough = s.breakthrough and not improved
        row = {"iteration": s.iteration, "family": family, "metric": value, "verdict": verdict, "failed": sorted(failed), "plan": plan, "gain": gain if improved else 0.0, "improved": improved, "area": area, "outcome": outcome}
        append_jsonl(self.folder / "experiments.jsonl", row)
        self.spend(tokens)
        self._replace("PLANS.json", {"recent": [*self._load("PLANS.json").get("recent", []), plan][-10:]})
        arms = self._load("BANDIT.json")
        arm = arms.setdefault(family, [1.0, 1.0])
        reward = max(0.0, min(1.0, row["gain"]))
        arms[family] = [arm[0] + reward, arm[1] + 1 - reward]
        self._replace("BANDIT.json", arms)
        self._replace("STATE.json", asdict(s))
        return row

    def spend(self, tokens: int) -> int:
        ledger = read_jsonl(self.folder / "ledger.jsonl")
        total = (ledger[-1]["total"] if ledger else 0) + tokens
        append_jsonl(self.folder / "ledger.jsonl", {"sequence": len(ledger) + 1, "tokens": tokens, "total": total})
        return total

    def spent(self) -> float:
        ledger = read_jsonl(self.folder / "ledger.jsonl")
        return (ledger[-1]["total"] if ledger else 0) / self.mission.token_cap

    def arms(self) -> dict[str, float]:
        """Posterior means by family."""
        found = self._load("BANDIT.json")
        return {f: (a := found.get(f, [1.0, 1.0]))[0] / sum(a) for f in dict.fromkeys((*FAMILIES, *found))}

    def pick(self, seed: int = 0) -> str:
        """Thompson sampling over families."""
        draw, found = np.random.default_rng(seed), self._load("BANDIT.json")
        sampled = {f: float(draw.beta(*found.get(f, [1.0, 1.0]))) for f in dict.fromkeys((*FAMILIES, *found))}
        return max(sampled, key=sampled.get)

    def looping(self, window: int = 3, flat: float = 1e-4) -> bool:
        """Whether the last plans are one plan and their metrics do not move; unknown metrics never make a loop."""
        rows = self.experiments()[-window:]
        values = [r["metric"] for r in rows if r["metric"] is not None]
        return len(values) == window and len({r["plan"] for r in rows}) == 1 and bool(rows[0]["plan"]) and max(values) - min(values) < flat

    def stop_reasons(self) -> list[str]:
        """Why to stop; ``escalation_required`` alone is no reason to."""
        m, s, rows = self.mission, self.state, self.experiments()
        last = rows[-m.failure_window :]
        broad = len({r["family"] for r in rows if r["verdict"] != "FAIL"}) >= LEAST_FAMILIES
        shared = sorted(set.intersection(*(set(r["failed"]) for r in last))) if len(last) == m.failure_window and all(r["verdict"] == "FAIL" for r in last) else []
        stuck = broad and not s.breakthrough and s.since_improvement >= m.stagnation_window
        poor = m.floor is not None and s.best is not None and self.better(m.floor, s.best)
        escalates = stuck and poor and s.entries < m.breakthroughs
        rules = (
            ("goal_met", s.best is not None and not self.better(m.threshold, s.best)),
            ("budget_exhausted", self.spent() >= 1),
            ("breakthrough_stagnation", broad and s.breakthrough and s.in_breakthrough >= m.breakthrough_window),
            ("escalation_required", escalates),
            ("stagnation", stuck and not escalates),
            ("iteration_cap", s.iteration >= m.iteration_cap),
            (f"catastrophic_skeptic:{shared}", bool(shared)),
        )
        if escalates:
            s.breakthrough, s.in_breakthrough, s.entries = True, 0, s.entries + 1
            self._replace("STATE.json", asdict(s))
            append_jsonl(self.folder / "breakthroughs.jsonl", {"entry": s.entries, "iteration": s.iteration, "best": s.best, "queries": literature_queries(self.mission)})
        return [name for name, holds in rules if holds]

    def halted(self) -> bool:
        return any(r != "escalation_required" for r in self.stop_reasons())

    def recommendation(self) -> dict:
        """The best accepted experiment, a confidence tier, and the newest of each family as evidence."""
        rows = [r for r in self.experiments() if r["metric"] is not None and r["verdict"] != "FAIL"]
        if not rows:
            return {"best": None, "confidence": "none", "evidence": []}
        best = (max if self.mission.higher_is_better else min)(rows, key=lambda r: r["metric"])
        newest = {r["family"]: r for r in rows}
        evidence = [best, *sorted((r for r in newest.values() if r["iteration"] != best["iteration"]), key=lambda r: -r["iteration"])][:5]
        met = best["metric"] >= self.mission.threshold if self.mission.higher_is_better else best["metric"] <= self.mission.threshold
        return {"best": best, "confidence": "high" if met and best["verdict"] == "ACCEPT" else "medium" if met or len(newest) >= LEAST_FAMILIES else "low", "evidence": evidence}


def projects_in(workspace: str | Path) -> list[dict]:
    """The status of every project folder."""
    return [Project(p.parent).status() for p in sorted(Path(workspace).glob("*/MISSION.json"))]


def literature_queries(mission: Mission, capability: str = "") -> list[str]:
    """Search strings for a task, from the more to the less special."""
    about = [w for w in (mission.domain.replace("_", " ") if mission.domain != "general" else "", mission.target.replace("_", " ")) if w]
    return [" ".join([*about, tail]) for tail in (capability.replace("_", " ") or "prediction", "feature engineering", "state of the art")]


def literature_hits(hits: Iterable[dict], k: int = 10) -> list[dict]:
    """Hits in one form, one of each title, newest and then best first."""
    rows = [{"title": str(h.get("title") or "").strip(), "year": int(h["year"]) if str(h.get("year") or "").isdigit() else 0, "score": float(h.get("score") or 0.0), "url": h.get("url") or h.get("link") or ""} for h in hits]
    best = {r["title"].lower(): r for r in sorted(rows, key=lambda r: (r["year"], r["score"])) if r["title"]}
    return sorted(best.values(), key=lambda r: (-r["year"], -r["score"], r["title"]))[:k]


@dataclass
class Library:
    """Findings of finished projects: hypotheses and similarity vectors, one JSON line each; the latest of a project wins."""

    path: Path
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows = list({r["project"]: r for r in read_jsonl(self.path) if "project" in r}.values())

    def add(self, project: str, vector: list[float], hypotheses: list[dict], capability: str, tier: int = 0, domain: str = "general", failures: Iterable[dict] = ()) -> None:
        row = {"project": project, "vector": vector, "hypotheses": hypotheses, "capability": capability, "tier": tier, "domain": domain, "failures": list(failures)}
        append_jsonl(self.path, row)
        self.__post_init__()

    def similar(self, vector: list[float], k: int = 5) -> list[tuple[str, float]]:
        """Projects by cosine, a hundredth of the tier added."""
        found = [(r["project"], cosine(r["vector"], vector) + 0.01 * r["tier"]) for r in self.rows]
        return sorted(found, key=lambda p: (-p[1], p[0]))[:k]

    def summary(self, domain: str | None = None, capability: str | None = None) -> dict:
        """How many projects and hypotheses there are, of which domains and capabilities."""
        rows = [r for r in self.rows if (domain is None or r.get("domain") == domain) and (capability is None or r["capability"] == capability)]
        return {"projects": len(rows), "hypotheses": sum(len(r["hypotheses"]) for r in rows), "domains": sorted({r.get("domain", "general") for r in rows}), "capabilities": sorted({r["capability"] for r in rows})}

    def failures(self, capability: str | None = None) -> list[dict]:
        """Failure clusters of the projects, the largest first."""
        found = [{**c, "project": r["project"]} for r in self.rows if capability in (None, r["capability"]) for c in r.get("failures", [])]
        return sorted(found, key=lambda c: (-c["n"], c["project"], c["cluster_id"]))

    def project(self, name: str) -> dict | None:
        return next((r for r in self.rows if r["project"] == name), None)

    def hypotheses(self, capability: str, least_gain: float = 0.0) -> list[dict]:
        found = [h for r in self.rows if r["capability"] == capability for h in r["hypotheses"] if h.get("gain", 0.0) >= least_gain]
        return sorted(found, key=lambda h: -h.get("gain", 0.0))


def cosine(a: list[float], b: list[float]) -> float:
    x, y = np.array(a, float), np.array(b, float)
    size = float(np.linalg.norm(x) * np.linalg.norm(y)) if len(x) == len(y) else 0.0
    return float(x @ y) / size if size else 0.0
