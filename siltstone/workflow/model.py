"""Workflows as plain data: reading, checking, storing."""

from __future__ import annotations

import json
import os
import re

STEP_KINDS = ("search", "if", "retry", "forEach", "export", "fileOperation", "runProgram", "stop")
OPERATORS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
VERSION = 1
_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


class WorkflowError(ValueError):
    """A workflow can't be read or run; ``problems`` lists why."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def load(text: str) -> dict:
    try:
        w = json.loads(text)
    except json.JSONDecodeError as e:
        raise WorkflowError([f"not JSON: {e}"]) from e
    problems = validate(w)
    if problems:
        raise WorkflowError(problems)
    return w


def bodies(step: dict) -> list[tuple[str, list[dict]]]:
    """The step lists inside a step."""
    return [(k, step[k]) for k in ("then", "else", "steps") if isinstance(step.get(k), list)]


def validate(w: dict) -> list[str]:
    """What is wrong with a workflow, empty if nothing is. References must go to searches that come before."""
    if not isinstance(w, dict):
        return ["a workflow is an object"]
    out: list[str] = []
    if w.get("version", 1) > VERSION:
        out.append(f"version {w['version']} is newer than {VERSION}")
    if not w.get("name"):
        out.append("a workflow needs a name")
    if not w.get("steps"):
        out.append("a workflow needs steps")
    seen: set[str] = set()

    def refer(step: dict, field: str, known: set[str]) -> None:
        if step.get(field) is not None and step[field] not in known:
            out.append(f"step '{step.get('id')}' refers to '{step[field]}', which is no earlier search")

    def walk(steps: list[dict], known: set[str]) -> set[str]:
        for s in steps:
            kind, sid = s.get("type"), s.get("id")
            if kind not in STEP_KINDS:
                out.append(f"unknown step type '{kind}'")
                continue
            if not sid or not _NAME.fullmatch(str(sid)):
                out.append(f"a {kind} step needs an id")
            elif sid in seen:
                out.append(f"the id '{sid}' is used twice")
            seen.add(sid)
            if kind == "search":
                if not str(s.get("query", "")).strip():
                    out.append(f"search '{sid}' needs a query")
                refer(s, "scope", known)
            if kind in ("if", "retry"):
                c = s.get("condition") or {}
                if c.get("metric", "hitCount") not in ("hitCount", "fileCount") or c.get("op") not in OPERATORS or not isinstance(c.get("value"), int):
                    out.append(f"{kind} '{sid}' needs a condition")
                if kind == "if":
                    refer(c, "step", known)
            if kind in ("forEach", "export", "fileOperation"):
                refer(s, "source", known)
            if kind == "export" and (not s.get("path") or s.get("format") not in ("json", "csv", "markdown")):
                out.append(f"export '{sid}' needs a path and a format")
            if kind == "fileOperation" and (s.get("operation") not in ("copy", "move") or not s.get("target") or s.get("collision", "skip") not in ("skip", "overwrite", "rename")):
                out.append(f"file operation '{sid}' needs an operation, a target and a known way with collisions")
            if kind == "runProgram" and not s.get("program"):
                out.append(f"run '{sid}' needs a program")
            if kind in ("retry", "forEach") and not s.get("steps") or kind == "if" and not s.get("then"):
                out.append(f"{kind} '{sid}' has no steps")
            for _, body in bodies(s):
                known = known | walk(body, known)
            if kind == "search" and sid:
                known = known | {sid}
        return known

    walk(w.get("steps") or [], set())
    return out


class Store:
    """Workflows as one JSON file each, written aside and moved into place."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, name: str) -> str:
        safe = re.sub(r"[^\w-]+", "_", name).strip("_")
        if not safe:
            raise WorkflowError(["a workflow needs a name"])
        return f"{self.folder}/{safe}.json"

    def save(self, w: dict) -> None:
        problems = validate(w)
        if problems:
            raise WorkflowError(problems)
        path = self._path(w["name"])
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump({"version": VERSION} | w, f, ensure_ascii=False, indent=1)
        os.replace(f"{path}.part", path)

    def get(self, name: str) -> dict:
        with open(self._path(name), encoding="utf-8") as f:
            return load(f.read())

    def names(self) -> list[str]:
        return sorted(x[:-5] for x in os.listdir(self.folder) if x.endswith(".json"))

    def delete(self, name: str) -> None:
        os.unlink(self._path(name))
