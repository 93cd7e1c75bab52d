"""Reports of a project: synthesis, final recommendation, and what other projects can learn."""

from __future__ import annotations

import re

from tarnwell.control.project import LEAST_FAMILIES, Capability, Library, Project

GAIN = 0.1


def synthesis(project: Project, capability: Capability, last: int = 5) -> dict:
    """What a reviewer needs: the task, the best and the last experiments, the arms."""
    rows = project.experiments()
    best = project.recommendation()["best"]
    return {
        "iteration": project.state.iteration,
        "capability": capability.key,
        "signature": capability.signature,
        "metric": project.mission.metric or capability.primary,
        "higher_is_better": project.mission.higher_is_better,
        "threshold": project.mission.threshold,
        "best": best["metric"] if best else None,
        "best_iteration": best["iteration"] if best else None,
        "recent": [{k: r.get(k) for k in ("iteration", "family", "area", "metric", "verdict", "gain")} for r in rows[-last:]],
        "arms": project.arms(),
    }


def synthesis_text(scaffold: dict, notes: str = "") -> str:
    """The scaffold as Markdown, with a reviewer's notes."""
    best = "none yet" if scaffold["best"] is None else f"{scaffold['best']:.4f} at iteration {scaffold['best_iteration']}"
    sign = ">=" if scaffold["higher_is_better"] else "<="
    table = ["| iteration | family | area | metric | verdict |", "| --- | --- | --- | --- | --- |", *(f"| {r['iteration']} | {r['family']} | {r['area']} | {r['metric']} | {r['verdict']} |" for r in scaffold["recent"])]
    arms = [f"- {family}: {mean:.3f}" for family, mean in sorted(scaffold["arms"].items(), key=lambda p: (-p[1], p[0]))]
    parts = [f"# Synthesis at iteration {scaffold['iteration']}", f"{scaffold['capability']} ({scaffold['signature']}), goal {scaffold['metric']} {sign} {scaffold['threshold']}, best {best}", "\n".join(table), "## Arms\n\n" + "\n".join(arms)]
    return "\n\n".join([*parts, *([f"## Notes\n\n{notes}"] if notes else [])]) + "\n"


def directives_of(text: str) -> list[dict]:
    """Lines "- try: ...", "- avoid: ..." and "- focus: ..." of a review, with the names in backquotes as features."""
    return [{"kind": kind.lower(), "text": rest.strip(), "features": re.findall(r"`([^`]+)`", rest)} for kind, rest in re.findall(r"^\s*[-*]\s*(try|avoid|focus)\s*:\s*(.+)$", text, re.M | re.I)]


def final(project: Project, capability: Capability, effect: dict | None = None, clusters: list[dict] | None = None) -> dict:
    """The recommendation with its reasons: decision, effect of the first feature, evidence, failures, and what would change it."""
    found = project.recommendation()
    best, tier = found["best"], found["confidence"]
    met = tier in ("medium", "high")
    plan = ((best or {}).get("outcome") or {}).get("plan", {})
    features = ((best or {}).get("outcome") or {}).get("features", [])
    metric = project.mission.metric or capability.primary
    why = [f"Iteration {best['iteration']} ({plan.get('model', best['family'])}) reached {metric} = {best['metric']:.4f}."] if best else []
    why.append(f"Capability: {capability.signature}.")
    why.append("The goal was not met; that is recorded as it is." if not met else "No effect was estimated." if effect is None else f"Effect of {effect.get('treatment')}: {effect['effect']:.4f} ({effect['low']:.4f} to {effect['high']:.4f}).")
    return {
        "project": project.folder.name,
        "confidence": tier,
        "decision": f"Adopt {plan.get('model', best['family'])} with features {features[:5]}." if met else "No actionable signal; collect more data.",
        "rationale": " ".join(why),
        "effect": effect if met else None,
        "evidence": [r["iteration"] for r in found["evidence"]],
        "assumptions": ["no unmeasured confounder strong enough to change the effect's sign"],
        "ruled_out": [{"name": c["cluster_id"], "n": c["n"]} for c in (clusters or [])[:5]],
        "would_change_it": [f"{metric} fails the goal on a held-out window", "a new failure cluster keeps firing"],
        "model_card": [{"model": plan.get("model"), "metric": metric, "value": best["metric"], "split": capability.split, "seed": plan.get("seed")}] if best else [],
    }


def final_text(found: dict) -> str:
    """A recommendation as Markdown."""
    lists = {"Assumptions": found["assumptions"], "Would change it": found["would_change_it"], "Ruled out": [f"{c['name']} ({c['n']})" for c in found["ruled_out"]], "Models": [f"{m['model']}: {m['metric']} = {m['value']}" for m in found["model_card"]]}
    parts = [f"# {found['project']}: recommendation", f"Confidence: {found['confidence']}", f"## Decision\n\n{found['decision']}", f"## Reasons\n\n{found['rationale']}", f"Evidence: iterations {found['evidence']}"]
    return "\n\n".join([*parts, *(f"## {title}\n\n" + "\n".join(f"- {x}" for x in rows) for title, rows in lists.items() if rows)]) + "\n"


def write_final(project: Project, capability: Capability, **more) -> dict:
    """FINAL.json and FINAL.md. A goal that is not met after too few families is refused, so that work goes on."""
    found = final(project, capability, **more)
    tried = {r["family"] for r in project.experiments()}
    if found["confidence"] == "low" and len(tried) < LEAST_FAMILIES and not project.halted():
        raise ValueError(f"only {len(tried)} families were tried; go on, or stop by a rule")
    project.write("FINAL.json", found)
    (project.folder / "FINAL.md").write_text(final_text(found))
    return found


def extracted(project: Project, capability: Capability, library: Library, vector: list[float], least_gain: float = GAIN) -> dict:
    """Add a project's useful patterns and failures to the library; features appear by number only, not by name."""
    rows = project.experiments()
    told = [{"summary": f"{r['area']}: {(r.get('outcome') or {}).get('plan', {}).get('model', r['family'])} ({len((r.get('outcome') or {}).get('features', []))} features)", "family": r["family"], "model": (r.get("outcome") or {}).get("plan", {}).get("model"), "features": [f for f in (r.get("outcome") or {}).get("plan", {}).get("features", []) if f[:1] == "+" or ":" in f], "gain": r["gain"]} for r in rows if r["verdict"] != "FAIL" and r["gain"] >= least_gain]
    failures: dict[str, int] = {}
    for r in rows:
        for name in r["failed"] if r["verdict"] == "FAIL" else ():
            failures[name] = failures.get(name, 0) + 1
    tier = {"high": 2, "medium": 1}.get(project.recommendation()["confidence"], 0)
    library.add(project.folder.name, vector, told, capability.key, tier, project.mission.domain, [{"cluster_id": k, "n": n} for k, n in sorted(failures.items())])
    return {"hypotheses": len(told), "failures": len(failures)}
