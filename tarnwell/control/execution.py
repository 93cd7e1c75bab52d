"""Plans: checked, executed on a table, recorded, and replayed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.control import models
from tarnwell.control.project import Capability, Mission, Project, audit, fingerprint
from tarnwell.operators import profile, sampling
from tarnwell.operators.metrics import check_metrics
from tarnwell.plans.features import Context, expand

#: References that ground a plan: an address, an arXiv number or a DOI.
REFERENCE = re.compile(r"^(https?://\S+|arxiv:\S+|doi:\S+|10\.\d{4,}/\S+)$", re.I)
POPULATION_EVERY = 10


@dataclass(frozen=True)
class Plan:
    """One experiment: a model on features, and why."""

    id: str
    model: str
    features: tuple[str, ...]
    family: str
    area: str = "baseline"
    evidence: str = "prior_experiment"
    reference: str = ""
    expected_gain: float = 0.0
    hypothesis: str = ""
    iteration: int = 0
    seed: int = 0
    folds: int = 5

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.model, self.family, self.area, self.features)

    def faults(self, recent: Iterable[str] = (), breakthrough: bool = False) -> list[str]:
        """What is wrong with the plan; recent: fingerprints that it must not repeat; breakthrough: whether it needs a domain prior with a reference."""
        rules = {
            "id must start with P-": not self.id.startswith("P-"),
            "features must not be empty": not self.features or any(not f.strip() for f in self.features),
            "expected gain must not be negative": self.expected_gain < 0,
            "repeats a recent plan": self.fingerprint in set(recent),
            "needs a domain prior": breakthrough and self.evidence != "domain_prior",
            "needs an address, arXiv number or DOI as reference": breakthrough and not REFERENCE.match(self.reference),
        }
        return [text for text, broken in rules.items() if broken]


@dataclass
class Outcome:
    """What came of a plan."""

    plan: Plan
    features: list[str] = field(default_factory=list)
    train: dict[str, float | None] = field(default_factory=dict)
    valid: dict[str, float | None] = field(default_factory=dict)
    primary: str = ""
    value: float | None = None
    verdict: str = "FAIL"
    failed: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    reason: str = ""

    def row(self) -> dict:
        return asdict(self)


def context_of(mission: Mission, row_id: str | None, interactions: Sequence[tuple[str, str]] = ()) -> Context:
    return Context(target=mission.target, time=mission.time, group=mission.group, forbidden=tuple(mission.forbidden), row_id=row_id, fold="fold", interactions=tuple(interactions))


def folds_of(df: DataFrame, capability: Capability, mission: Mission, row_id: str, k: int = 5, seed: int = 0) -> models.Split:
    """Rows of (row_id, fold, role) by the capability's way of splitting; each row validates at most once a fold.

    stratified: by turns within classes; group: whole groups; time and rolling: train
    before valid, the latter a gap later. Where what a way needs is missing, folds go by hash.
    """
    if capability.split in ("time", "rolling") and mission.time:
        rolling = capability.split == "rolling"
        return models.Split(sampling.time_folds(df, mission.time, row_id, parts=k + 2 if rolling else k + 1, splits=k), [row_id], list(range(1, k + 1)))
    if capability.split == "group" and mission.group:
        dealt = df.join(sampling.group_folds(df, mission.group, k), mission.group).select(row_id, F.col("fold").alias("own"))
    elif capability.split == "stratified":
        dealt = sampling.stratified_folds(df.select(row_id, mission.target, F.xxhash64(row_id, F.lit(seed)).alias("__turn")), mission.target, "__turn", k).select(row_id, F.col("fold").alias("own"))
    else:
        dealt = df.select(row_id, sampling.hashed_fold([row_id], k, seed).alias("own"))
    rows = dealt.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), "own")
    return models.Split(rows.select(row_id, "fold", F.when(F.col("own") == F.col("fold"), F.lit("valid")).otherwise(F.lit("train")).alias("role")), [row_id], list(range(k)))


def execute(df: DataFrame, plan: Plan, mission: Mission, capability: Capability, row_id: str, interactions: Sequence[tuple[str, str]] = (), recent: Iterable[str] = (), breakthrough: bool = False, strict: bool = False, population: bool | None = None) -> Outcome:
    """Check, expand, audit, fit by folds, measure and judge. A plan that cannot be carried out gives an outcome that says why, never an exception.

    population: also measure on all rows, by default every tenth iteration; those metrics end in _pop.
    """
    out = Outcome(plan, primary=mission.metric or capability.primary)
    if faults := plan.faults(recent, breakthrough):
        out.reason = "; ".join(faults)
        return out
    if lacking := capability.lacking(mission):
        out.reason = f"the task needs {lacking}"
        return out
    context = context_of(mission, row_id, interactions)
    try:
        split = folds_of(df, capability, mission, row_id, plan.folds, plan.seed)
        expanded = expand(df, list(plan.features), context)
        numbers = set(profile.numeric_columns(expanded.frame))
        out.features = [c for c in expanded.columns if c in numbers and c != mission.target]
        if bad := audit(out.features, mission, expanded.lineage, plan.area):
            out.reason = f"leakage: {sorted(bad)}"
            out.failed = ["leakage_audit"]
            return out
        if not out.features and capability.split != "rolling":
            out.reason = "no usable features"
            return out
        names = tuple(dict.fromkeys((*capability.metrics, out.primary)))
        out.valid, out.train = models.train_and_validate(expanded.frame, split, out.features, mission.target, plan.model, names, plan.seed, mission.time, (out.primary,))
        if population if population is not None else plan.iteration > 0 and plan.iteration % POPULATION_EVERY == 0:
            rows = models.prepared(expanded.frame, out.features, mission.target)
            fit = models.build(plan.model, out.features, mission.target, plan.seed).fit(rows, mission.time, [row_id])
            out.valid |= models.population(models.judged(fit, rows, mission.target, [row_id]), names)
    except Exception as error:  # the log must say what failed
        out.reason = f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"
        return out
    found = out.valid.get(out.primary)
    out.value = found if found is not None and math.isfinite(found) else None
    checked = check_metrics(out.valid, out.train, len(out.features), out.primary, strict=strict)
    out.verdict, out.failed, out.warnings = checked["verdict"], checked["failed"], checked["warnings"]
    return out


def run_plan(project: Project, df: DataFrame, plan: Plan, capability: Capability, row_id: str, tokens: int = 0, **more) -> Outcome:
    """execute(), recorded in the project with the whole outcome beside the row."""
    recent = project.recent_plans() if project.looping() else ()
    out = execute(df, plan, project.mission, capability, row_id, recent=recent, breakthrough=project.state.breakthrough, **more)
    project.record(plan.family, out.value, out.verdict, out.failed, plan.fingerprint, tokens, outcome=out.row(), area=plan.area)
    return out


def replay(project: Project, df: DataFrame, capability: Capability, row_id: str, upto: int | None = None, **more) -> dict:
    """Run every recorded plan again and compare the primary metrics: id, original, replayed and their distance."""
    drift = []
    for row in project.experiments():
        if upto is not None and row["iteration"] > upto:
            break
        if not row.get("outcome"):
            continue
        told = row["outcome"]["plan"]
        plan = Plan(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})
        again = execute(df, plan, project.mission, capability, row_id, breakthrough=False, **more)
        a, b = row["outcome"]["value"], again.value
        drift.append({"id": plan.id, "primary_metric": again.primary, "original": a, "replayed": b, "abs_delta": abs(a - b) if a is not None and b is not None else None})
    return {"replayed": len(drift), "drift": drift}
