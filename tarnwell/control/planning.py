"""From a profile to a locked mission: guesses, questions, answers and recipes."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from tarnwell.control.domains import domain
from tarnwell.control.hypotheses import SEEDS, first_of_each
from tarnwell.control.project import Capability, Mission, Project, capability_for
from tarnwell.sources.tables import append_jsonl


def read_json(path: str | Path) -> dict:
    """A recipe, seed or profile file; an empty dict where there is none."""
    path = Path(path)
    return json.loads(path.read_text()) if path.exists() else {}


@dataclass(frozen=True)
class Recipe:
    """Usual settings of a kind of task."""

    key: str
    domain: str = "general"
    target_type: str = "binary"
    temporal: str = "none"
    split: str = "stratified"
    metric: str | None = None
    threshold: float | None = None
    higher_is_better: bool = True
    forbidden: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()

    @staticmethod
    def load(path: str | Path) -> Recipe:
        known = {f.name for f in fields(Recipe)}
        return Recipe(**{k: tuple(v) if isinstance(v, list) else v for k, v in read_json(path).items() if k in known})

    @property
    def capability(self) -> Capability:
        return capability_for(self.target_type, self.temporal, self.split)


#: Recipes with their criteria (fixed values).
RECIPES = {
    r.key: r
    for r in (
        Recipe("manufacturing_defect_classification", "manufacturing", "binary", "time", "time", "roc_auc", 0.78, True, ("qc_", "audit_", "inspector_", "downstream_", "release_", "lab_result_", "post_"), ("regime_specific_submodel", "stage_frontier_baseline", "lag_join_with_immediate_prior", "interaction_temp_pressure")),
        Recipe("demand_forecasting", "forecasting_demand", "continuous", "time", "rolling", "mape", 0.15, False, ("future_", "actuals_t_plus"), ("naive_seasonal_baseline", "lagged_ridge", "stl_decompose_then_residual_model")),
        Recipe("equipment_pdm", "manufacturing", "survival", "time", "group", "concordance_index", 0.7, True),
        Recipe("process_anomaly", "manufacturing", "binary", "none", "stratified", "average_precision", 0.5, True, seeds=("isolation_forest_baseline", "robust_pca_residual")),
        Recipe("tabular_regression_general", "general", "continuous", "none", "group", "rmse", None, False),
    )
}


def columns_of(report: dict) -> list[dict]:
    """Every table's profile rows, with the table's name; the first of each column."""
    return first_of_each([{**c, "table": t, "id": c["column"]} for t, found in sorted(report["tables"].items()) for c in found["columns"]], most=10**9)


def has_documents(report: dict) -> bool:
    return bool(report.get("documents"))


def guesses(report: dict, recipe: Recipe | None = None) -> dict:
    """The first likely target, time and group, and the columns that must not be used."""
    roles = {role: [c for t in sorted(report["tables"]) for c in report["tables"][t]["roles"][role]] for role in ("target", "time", "id")}
    target = next(iter(roles["target"]), None)
    names = [c["column"] for c in columns_of(report)]
    chosen = domain(recipe.domain if recipe else None)
    forbidden = chosen.forbidden_columns(names, target) if target else []
    marks = recipe.forbidden if recipe else ()
    forbidden += [c for c in names if c != target and c not in forbidden and any(m in c.lower() for m in marks)]
    return {"target": target, "time": next(iter(roles["time"]), None), "group": next(iter(roles["id"]), None), "forbidden": forbidden, "joins": report.get("joins", [])}


@dataclass(frozen=True)
class Question:
    """One thing to ask; kind: confirm a guess, choose, or free text."""

    id: str
    field: str
    prompt: str
    kind: str = "confirm"
    guess: object = None
    confidence: float = 0.0


def questions(report: dict, recipe: Recipe | None = None) -> list[Question]:
    """Guesses to confirm, and what nothing is known of; the surest first in each batch."""
    found = guesses(report, recipe)
    asked = [Question("Q-1", "target", f"Is `{found['target']}` the target column?", guess=found["target"], confidence=0.85) if found["target"] else Question("Q-1", "target", "Which column is the target?", "free_text")]
    needs_time = bool(recipe and recipe.temporal != "none")
    if needs_time and found["time"]:
        asked.append(Question("Q-2", "time", f"Is `{found['time']}` the time column?", guess=found["time"], confidence=0.85))
    elif needs_time:
        asked.append(Question("Q-2", "time", "Which column orders the rows in time?", "free_text"))
    if recipe and recipe.split == "group" and found["group"]:
        asked.append(Question("Q-3", "group", f"Is `{found['group']}` the entity column?", guess=found["group"], confidence=0.7))
    if found["forbidden"]:
        asked.append(Question("Q-4", "forbidden", "Are these columns forbidden, as they follow from the target?", guess=tuple(found["forbidden"]), confidence=0.7))
    if recipe and recipe.threshold is not None:
        asked.append(Question("Q-5", "threshold", f"Is {recipe.metric} {'>=' if recipe.higher_is_better else '<='} {recipe.threshold} the goal?", guess=recipe.threshold, confidence=0.6))
    if found["joins"]:
        asked.append(Question("Q-6", "joins", "Are the tables joined like this?", guess=tuple(found["joins"]), confidence=0.6))
    return asked


def resolved(asked: Iterable[Question], answers: dict[str, object]) -> dict:
    """Mission fields from answers by question id: True keeps the guess, None leaves the field out, anything else replaces it; unanswered guesses are kept."""
    found = {}
    for q in asked:
        answer = answers.get(q.id, True)
        value = q.guess if answer is True else answer
        if value is not None and value is not False:
            found[q.field] = tuple(value) if isinstance(value, (list, tuple)) else value
    return found


def mission_of(asked: Iterable[Question], answers: dict[str, object], recipe: Recipe | None = None, **more) -> Mission:
    """A checked mission of the answers, the recipe's criterion and further fields."""
    known = resolved(asked, answers)
    usual = {"metric": recipe.metric, "higher_is_better": recipe.higher_is_better, "domain": recipe.domain} if recipe else {}
    return Mission(**usual | known | more)


def locked(folder: str | Path, mission: Mission, capability: Capability, recipe: Recipe | None = None) -> Project:
    """Write the mission, the columns, the join plan and the first hypotheses; ValueError if the capability needs what is not there."""
    if lacking := capability.lacking(mission):
        raise ValueError(f"{capability.key} needs {lacking}")
    project = Project(folder, mission)
    project.write("COLUMNS.json", {"target": mission.target, "time": mission.time, "group": mission.group, "forbidden": list(mission.forbidden), "capability": capability.key, "signature": capability.signature})
    project.write("JOIN_PLAN.json", {"joins": [dict(j) if isinstance(j, dict) else asdict(j) for j in mission.joins]})
    own = [(f"H-domain-{mission.domain}", name) for name in domain(mission.domain).seeds] + [(f"H-recipe-{recipe.key}", name) for name in (recipe.seeds if recipe else ())]
    seeds = [dict(s) for s in SEEDS] + [{"id": f"{origin}-{name}", "name": name, "family": "boosted_tree", "area": "features", "model": "lgbm_default", "features": ["+all_allowed"], "gain": 0.5} for origin, name in own]
    (project.folder / "hypotheses.jsonl").unlink(missing_ok=True)
    for row in first_of_each(seeds, most=len(seeds)):
        append_jsonl(project.folder / "hypotheses.jsonl", row)
    project.write("STATUS.json", {"status": "planned"})
    return project
