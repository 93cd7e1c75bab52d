"""Command line: python -m tarnwell.cli new-project | list | status | archive | library | domains | audit | migrate | extract | replay | serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tarnwell.control import domains, servers
from tarnwell.control.planning import RECIPES
from tarnwell.control.project import CAPABILITIES, Library, Mission, Project, projects_in


def workspace(path: str | None) -> Path:
    """The given folder, or the nearest one above that has a folder projects, or this one."""
    if path:
        return Path(path)
    here = Path.cwd()
    return next((p / "projects" for p in (here, *here.parents) if (p / "projects").is_dir()), here)


def audited(root: Path) -> list[dict]:
    """Files of projects that cannot be read as what they are, and state whose counts do not fit the log."""
    found = []
    for mission in sorted(root.glob("*/MISSION.json")):
        for path in sorted(mission.parent.glob("*.json")):
            try:
                json.loads(path.read_text())
            except ValueError as error:
                found.append({"file": str(path), "fault": str(error)})
        try:
            project = Project(mission.parent)
            if project.state.iteration != len(project.experiments()):
                found.append({"file": str(mission.parent), "fault": "the log and the state have different counts"})
        except (TypeError, ValueError) as error:
            found.append({"file": str(mission), "fault": str(error)})
    return found


def replayed(project: Project, table: str, capability: str, row_id: str, upto: int | None) -> dict:
    from pyspark.sql import SparkSession

    from tarnwell.control.execution import replay
    from tarnwell.sources.tables import read_one

    spark = SparkSession.builder.getOrCreate()
    return replay(project, read_one(spark, table), CAPABILITIES[capability], row_id, upto)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tarnwell")
    out.add_argument("--workspace")
    of = out.add_subparsers(dest="command", required=True)
    new = of.add_parser("new-project")
    new.add_argument("name")
    new.add_argument("--target", required=True)
    new.add_argument("--domain", default="general", choices=sorted(domains.DOMAINS))
    new.add_argument("--recipe", choices=sorted(RECIPES))
    new.add_argument("--budget", type=int, required=True, help="thousands of tokens")
    of.add_parser("list")
    for name in ("status", "archive", "migrate"):
        of.add_parser(name).add_argument("project")
    extract = of.add_parser("extract")
    extract.add_argument("project")
    extract.add_argument("--capability", required=True, choices=sorted(CAPABILITIES))
    extract.add_argument("--sketch", help="folder of the project's sketch, for its similarity vector")
    library = of.add_parser("library")
    library.add_argument("--domain")
    library.add_argument("--capability")
    of.add_parser("domains")
    of.add_parser("audit")
    again = of.add_parser("replay")
    again.add_argument("project")
    again.add_argument("table")
    again.add_argument("--capability", required=True, choices=sorted(CAPABILITIES))
    again.add_argument("--row-id", required=True)
    again.add_argument("--up-to-iteration", type=int)
    serve = of.add_parser("serve")
    serve.add_argument("what", choices=("sketch", "retrieval", "budget"))
    serve.add_argument("path")
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    root = workspace(a.workspace)
    if a.command == "serve":
        from tarnwell.plans.sketch import Sketch

        tools = servers.sketch_tools(Sketch(a.path)) if a.what == "sketch" else servers.retrieval_tools(Library(Path(a.path))) if a.what == "retrieval" else servers.budget_tools(Project(a.path))
        servers.serve(tools, sys.stdin, sys.stdout)
        return 0
    if a.command == "new-project":
        recipe = RECIPES.get(a.recipe)
        usual = {"metric": recipe.metric, "higher_is_better": recipe.higher_is_better, "threshold": recipe.threshold or 1.0} if recipe else {}
        answer = Project(root / a.name, Mission(target=a.target, domain=a.domain, token_cap=a.budget * 1000, **usual)).status()
    elif a.command == "list":
        answer = projects_in(root)
    elif a.command == "status":
        answer = Project(root / a.project).status()
    elif a.command == "archive":
        project = Project(root / a.project)
        project.archive()
        answer = project.status()
    elif a.command == "migrate":
        answer = Project(root / a.project).migrate()
    elif a.command == "extract":
        from tarnwell.control.reports import extracted
        from tarnwell.plans.sketch import Sketch

        vector = Sketch(a.sketch).layers["similarity"] if a.sketch else []
        answer = extracted(Project(root / a.project), CAPABILITIES[a.capability], Library(root / "library.jsonl"), vector)
    elif a.command == "library":
        answer = Library(root / "library.jsonl").summary(a.domain, a.capability)
    elif a.command == "domains":
        answer = domains.listing()
    elif a.command == "audit":
        answer = audited(root)
    else:
        answer = replayed(Project(root / a.project), a.table, a.capability, a.row_id, a.up_to_iteration)
    print(json.dumps(answer, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
