"""Tools by name: over a sketch, a library or a project's budget; called directly or by lines of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import TextIO

from tarnwell.control.project import Library, Project
from tarnwell.plans.sketch import Sketch

Tools = dict[str, Callable[..., object]]


def sketch_tools(sketch: Sketch) -> Tools:
    return {name: lambda tool=name, **arguments: sketch.ask(tool, **arguments) for name in sketch.tools()}


def retrieval_tools(library: Library) -> Tools:
    return {
        "similar_projects": library.similar,
        "query_hypotheses": library.hypotheses,
        "query_failures": library.failures,
        "get_project": library.project,
        "summarize_library": library.summary,
        "list_projects": lambda: [r["project"] for r in library.rows],
    }


def budget_tools(project: Project) -> Tools:
    return {
        "record": lambda tokens: {"total": project.spend(int(tokens))},
        "totals": lambda: {"spent": project.spent(), "cap": project.mission.token_cap},
        "remaining": lambda: {"tokens": max(0, round(project.mission.token_cap * (1 - project.spent())))},
    }


def call(tools: Tools, name: str, arguments: dict | None = None) -> object:
    """A tool's answer; unknown tools and failures give {"error": ...}."""
    if name not in tools:
        return {"error": f"unknown tool: {name}"}
    try:
        return tools[name](**(arguments or {}))
    except Exception as error:  # an answer must come back whatever the arguments are
        return {"error": f"{type(error).__name__}: {error}"}


def serve(tools: Tools, lines: Iterable[str], out: TextIO) -> None:
    """One answer for each line: {"name": ..., "args": {...}}, or JSON-RPC 2.0 with method tools/list, tools/call or a tool's name."""
    for line in lines:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
            if "jsonrpc" in asked:
                answer = {"jsonrpc": "2.0", "id": asked.get("id"), "result": _rpc(tools, asked.get("method", ""), asked.get("params") or {})}
            else:
                answer = call(tools, asked.get("name", ""), asked.get("args"))
        except (ValueError, AttributeError) as error:
            answer = {"error": f"{type(error).__name__}: {error}"}
        out.write(json.dumps(answer, default=str) + "\n")
        out.flush()


def _rpc(tools: Tools, method: str, params: dict) -> object:
    if method == "tools/list":
        return {"tools": [{"name": name} for name in sorted(tools)]}
    if method == "tools/call":
        return call(tools, params.get("name", ""), params.get("arguments"))
    return call(tools, method, params)
