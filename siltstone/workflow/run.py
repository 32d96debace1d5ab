"""Running a workflow. The data stays in DataFrames; the driver holds counts and at most the buffered hits of an export."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import Scratch
from siltstone.operators.results import export_document
from siltstone.query import build_query
from siltstone.workflow.model import OPERATORS, WorkflowError, validate

MOST_STEPS, BUFFER, EACH, RETRIES = 10_000, 10_000, 100, 5
_VARIABLE = re.compile(r"\$\{(\w+)\}")


@dataclass
class Outcome:
    status: str = "completed"  # completed, stopped, failed
    message: str = ""
    log: list[tuple[str, str]] = field(default_factory=list)


class _Stop(Exception):
    def __init__(self, ok: bool, message: str):
        super().__init__(message)
        self.ok, self.message = ok, message


class Runner:
    """``search(query, scope)`` answers a query with hits ``path, line_number, content``; ``scope`` is a DataFrame of paths or None.

    File operations are recorded and only carried out with ``dry_run=False``; programs are never started, only recorded.
    """

    def __init__(self, search: Callable[[object, DataFrame | None], DataFrame], dry_run: bool = True, today=None):
        self.search, self.dry_run, self.today = search, dry_run, today

    def run(self, workflow: dict, variables: dict[str, str] | None = None) -> Outcome:
        problems = validate(workflow)
        if problems:
            raise WorkflowError(problems)
        self.hits: dict[str, DataFrame] = {}
        self.counts: dict[str, dict[str, int]] = {}
        self.order: list[str] = []
        self.steps = 0
        self.out = Outcome()
        try:
            self._steps(workflow["steps"], dict(variables or {}))
        except _Stop as s:
            self.out.status, self.out.message = ("stopped" if s.ok else "failed"), s.message
        except Exception as e:  # noqa: BLE001  (a failed step fails the run, with its reason)
            self.out.status, self.out.message = "failed", f"{type(e).__name__}: {str(e)[:500]}"
        return self.out

    # -- steps

    def _steps(self, steps: list[dict], env: dict[str, str]) -> None:
        for s in steps:
            self.steps += 1
            if self.steps > MOST_STEPS:
                raise _Stop(False, f"more than {MOST_STEPS} steps")
            getattr(self, f"_do_{s['type']}")(s, env)

    def _fill(self, text: str, env: dict[str, str]) -> str:
        return _VARIABLE.sub(lambda m: env.get(m[1], m[0]), text)

    def _note(self, s: dict, what: str) -> None:
        self.out.log.append((s["id"], what))

    def _do_search(self, s: dict, env: dict[str, str]) -> None:
        q = build_query(self._fill(s["query"], env), s.get("mode", "unified"), s.get("caseSensitive", False), self.today)
        scope = self.hits[s["scope"]].select("path").distinct() if s.get("scope") else None
        hits = self.search(q, scope)
        hits = Scratch(hits.sparkSession).keep(hits)  # counted, searched in and exported: found once
        n = hits.agg(F.count("*").alias("hitCount"), F.count_distinct(F.lower("path")).alias("fileCount")).first()
        if s.get("maxHits"):
            hits = hits.orderBy("path", "line_number").limit(int(s["maxHits"]))
        self.hits[s["id"]], self.counts[s["id"]] = hits, n.asDict()
        self.order = [x for x in self.order if x != s["id"]] + [s["id"]]
        self._note(s, f"{n.hitCount} hits in {n.fileCount} files")

    def _holds(self, c: dict) -> bool:
        step = c.get("step") or (self.order[-1] if self.order else None)
        have = self.counts.get(step, {"hitCount": 0, "fileCount": 0})[c.get("metric", "hitCount")]
        return OPERATORS[c["op"]](have, c["value"])

    def _do_if(self, s: dict, env: dict[str, str]) -> None:
        yes = self._holds(s["condition"])
        self._note(s, "then" if yes else "else")
        self._steps(s["then"] if yes else s.get("else") or [], env)

    def _do_retry(self, s: dict, env: dict[str, str]) -> None:
        sets = s.get("parameterSets") or [{}] * int(s.get("maxIterations", RETRIES))
        for i, own in enumerate(sets[: int(s.get("maxIterations", len(sets)))], 1):
            self._steps(s["steps"], env | {k: str(v) for k, v in own.items()})
            if self._holds(s["condition"]):
                self._note(s, f"met after {i}")
                return
        self._note(s, "exhausted")

    def _do_forEach(self, s: dict, env: dict[str, str]) -> None:
        source = s.get("source") or (self.order[-1] if self.order else None)
        if source is None:
            return
        files = self.hits[source].groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("path")).orderBy("path").limit(int(s.get("maxFiles", EACH))).collect()
        for r in files:
            folder, _, name = r.path.rpartition("/")
            self._steps(s["steps"], env | {"file": r.path, "fileName": name, "directory": folder})
        self._note(s, f"{len(files)} files")

    def _source(self, s: dict) -> DataFrame | None:
        if s.get("source"):
            return self.hits[s["source"]]
        all_hits = [self.hits[x] for x in self.order]
        out = all_hits[0] if all_hits else None
        for h in all_hits[1:]:
            out = out.unionByName(h)
        return out

    def _do_export(self, s: dict, env: dict[str, str]) -> None:
        df = self._source(s)
        if df is None:
            self._note(s, "nothing to export")
            return
        n = export_document(df.select("path", "line_number", "content"), self._fill(s["path"], env), s["format"], BUFFER)
        self._note(s, f"exported {n} hits")

    def _do_fileOperation(self, s: dict, env: dict[str, str]) -> None:
        df = self._source(s)
        if df is None:
            return
        target = self._fill(s["target"], env)
        for r in df.select("path").distinct().orderBy("path").limit(BUFFER).toLocalIterator():
            to = f"{target}/{r.path.rpartition('/')[2]}"
            if os.path.exists(to):
                way = s.get("collision", "skip")
                if way == "skip":
                    self._note(s, f"skip {r.path}")
                    continue
                stem, ext = os.path.splitext(to)
                n = 1
                while way == "rename" and os.path.exists(to):
                    to, n = f"{stem} ({n}){ext}", n + 1
            self._note(s, f"{s['operation']} {r.path} -> {to}")
            if not self.dry_run:
                os.makedirs(target, exist_ok=True)
                (shutil.copy2 if s["operation"] == "copy" else shutil.move)(r.path, to)

    def _do_runProgram(self, s: dict, env: dict[str, str]) -> None:
        self._note(s, "not started: " + self._fill(" ".join([s["program"], *s.get("arguments", [])]), env))

    def _do_stop(self, s: dict, env: dict[str, str]) -> None:
        raise _Stop(s.get("success", True), self._fill(s.get("message", ""), env))


