"""What to try next: seeds, findings of the sketch, the user's own ideas, other projects, and arms not tried."""

from __future__ import annotations

import re
from collections.abc import Iterable

from tarnwell.control import models
from tarnwell.control.project import Capability, Library, Project

COLD, LEAST, MOST = 5, 8, 12
#: The first hypotheses of every project (fixed values).
SEEDS = (
    {"id": "H-seed-1", "name": "naive_baseline_all_features", "family": "linear", "area": "baseline", "model": "logreg_or_ridge", "features": ["+all_allowed"], "gain": 0.5},
    {"id": "H-seed-2", "name": "univariate_top3_champion", "family": "tree", "area": "features", "model": "lgbm_small", "features": ["sketch:top3_univariate"], "gain": 0.5},
    {"id": "H-seed-3", "name": "regime_specific_submodels", "family": "tree", "area": "regimes", "model": "lgbm_per_regime", "features": ["+all_allowed"], "gain": 0.6},
    {"id": "H-seed-4", "name": "interaction_augmented_baseline", "family": "boosted_tree", "area": "interactions", "model": "lgbm_default", "features": ["+all_allowed", "engineered:interactions_top5"], "gain": 0.55},
    {"id": "H-seed-5", "name": "leakage_probe", "family": "linear", "area": "leakage_probe", "model": "logreg_or_ridge", "features": ["+all_allowed", "+leak_canary"], "gain": 0.3},
)
#: Model keys of each family, most to be tried first (fixed values).
KEYS = {
    "linear": ("elasticnet", "logreg_l1", "logreg_elastic", "ridge_classifier", "logreg", "ridge"),
    "tree": ("extra_trees", "random_forest", "decision_tree", "lgbm_binary"),
    "boosted_tree": ("lgbm_focal", "lgbm_weighted", "xgboost_focal", "lgbm_binary"),
    "neural": ("mlp_tabular",),
    "ensemble": ("stacked_blend", "voting_soft", "bagging"),
    "rule_based": ("decision_tree", "logreg"),
    "survival": ("lgbm_aft", "cox_ph", "lgbm_survival"),
    "anomaly": ("autoencoder_anomaly", "isolation_forest", "ocsvm", "lof"),
    "forecasting_classical": ("theta", "ets", "naive_seasonal"),
    "forecasting_neural": ("ridge_lagged", "lgbm_regressor", "mlp_tabular_regressor"),
}


def _idea(iteration: int, name: str, family: str, area: str, model: str, features: list[str], gain: float, source: str, why: str) -> dict:
    return {"id": f"H-iter{iteration}-{name}", "name": name, "family": family, "area": area, "model": model, "features": features, "gain": gain, "source": source, "rationale": why}


def _of_pairs(layers: dict, target: str) -> list[tuple]:
    strength = lambda p: min(1.0, p.get("mutual_info") or p.get("abs_corr", 0.0))
    return [(f"interaction_{p['col_a']}_{p['col_b']}", "interactions", "lgbm_default", [p["col_a"], p["col_b"], "engineered:interactions_top5"], 0.5 + strength(p) / 2, "a pair of the joint layer") for p in layers.get("L2", {}).get("pairs", [])[:3]]


def _of_regimes(layers: dict, target: str) -> list[tuple]:
    n = len(layers.get("L3", {}).get("regimes", []))
    return [("regime_specific_submodel", "regimes", "lgbm_per_regime", ["+all_allowed"], 0.55, f"{n} regimes")] * (n > 1)


def _of_neighbours(layers: dict, target: str) -> list[tuple]:
    near = [end for e in layers.get("L6", []) for end, other in ((e["src"], e["dst"]), (e["dst"], e["src"])) if other == target]
    return [("neighbours_only", "causal", "logreg_or_ridge", near[:5], 0.55, "neighbours of the target")] * bool(near)


def _of_failures(layers: dict, target: str) -> list[tuple]:
    largest = sorted(layers.get("L7", []), key=lambda c: -c["n"])[:1]
    return [("robust_to_failure_cluster", "robustness", "lgbm_default", ["+all_allowed"], 0.45, f"{c['cluster_id']} has {c['n']} failures") for c in largest]


#: Each layer's ideas, and the family they are for; None is the family that was drawn.
SOURCES = ((_of_pairs, None), (_of_regimes, None), (_of_neighbours, None), (_of_failures, "ensemble"))


def from_sketch(layers: dict, target: str, family: str, iteration: int) -> list[dict]:
    """What the layers suggest, by the table of sources."""
    return [
        _idea(iteration, name, its_family or family, area, model, features, gain, "sketch", why)
        for source, its_family in SOURCES
        for name, area, model, features, gain, why in source(layers, target)
    ]


def from_notes(notes: str, columns: Iterable[str], family: str, iteration: int) -> list[dict]:
    """The table's columns that the user's notes name, in the order of the notes: as drivers, and with interactions if there are several."""
    known = set(columns)
    named = [w for w in dict.fromkeys(re.split(r"\W+", notes or "")) if w in known]
    if not named:
        return []
    drivers = _idea(iteration, "named_in_notes", family, "features", "logreg_or_ridge", named, 0.5, "user", "columns that the notes name")
    crossed = _idea(iteration, "named_in_notes_crossed", family, "interactions", "lgbm_default", [*named, "engineered:interactions_top5"], 0.55, "user", "pairs of columns that the notes name")
    return [drivers, crossed][: len(named)]


def from_library(library: Library | None, capability: Capability, family: str, iteration: int, most: int = 4) -> list[dict]:
    """What helped other projects of the same capability, with their models where these build."""
    known = set(models.available(models.MODELS))
    rows = library.hypotheses(capability.key, 0.2)[:most] if library else []
    return [
        _idea(iteration, f"elsewhere_{i}", h.get("family", family), "features", h["model"] if h.get("model") in known else "lgbm_default", list(h.get("features") or ["+all_allowed"]), min(0.85, h.get("gain", 0.0)), "library", h.get("summary", ""))
        for i, h in enumerate(rows)
    ]


def wildcards(project: Project, capability: Capability, iteration: int, breakthrough: bool) -> list[dict]:
    """Arms that were tried least; in a breakthrough each with a model that builds and was not tried."""
    tried = {(r.get("outcome") or {}).get("plan", {}).get("model") for r in project.experiments()}
    found = []
    for family in project.untried() or sorted(project.arms(), key=project.arms().get):
        keys = [k for k in models.available(KEYS.get(family, ())) if k in capability.allowed and k not in tried]
        if breakthrough and not keys:
            continue
        model = keys[0] if breakthrough else "logreg"
        found.append(_idea(iteration, f"wildcard_{family}_{model}" if breakthrough else f"wildcard_{family}", family, "baseline", model, ["+all_allowed"], 0.5, "wildcard", "an arm that is little explored"))
    return found


def first_of_each(rows: Iterable[dict], most: int = MOST) -> list[dict]:
    """Rows by id, the first of each, at most so many."""
    seen: dict[str, dict] = {}
    for row in rows:
        seen.setdefault(row["id"], row)
    return list(seen.values())[:most]


def generated(project: Project, capability: Capability, layers: dict | None = None, library: Library | None = None, seed: int = 0) -> list[dict]:
    """The seeds for the first COLD iterations, then LEAST to MOST ideas from all sources, each source in turn."""
    iteration = project.state.iteration
    if iteration < COLD:
        return [dict(s) for s in SEEDS]
    family = project.pick(seed)
    ideas = [
        *from_sketch(layers or {}, project.mission.target, family, iteration),
        *from_notes(project.mission.notes, [c["column"] for c in (layers or {}).get("L1", [])], family, iteration),
        *from_library(library, capability, family, iteration),
        *[_idea(iteration, f"directive_{i}", family, "features", "lgbm_default", list(d.get("features") or ["+all_allowed"]), 0.5, "directive", d.get("text", "")) for i, d in enumerate(project.directives())],
        *wildcards(project, capability, iteration, project.state.breakthrough),
    ]
    ideas += [{**s, "id": f"H-iter{iteration}-{s['name']}"} for s in SEEDS if len(ideas) < LEAST]
    return first_of_each(ideas)
