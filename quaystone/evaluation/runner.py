"""A golden set run against an answerer: verdicts, caches, budgets and the report."""

from __future__ import annotations

import hashlib
import json
import statistics
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from quaystone.evaluation.compare import Spec, compare, hit_at, reciprocal_rank
from quaystone.session import read_text, write_text


@dataclass(frozen=True)
class Case:
    """One question with exactly one kind of truth: SQL, sources or a behaviour."""

    id: str
    question: str
    route: str = "data"
    sql: str | None = None
    spec: Spec = field(default_factory=Spec)
    sources: tuple[tuple[str, str | None], ...] = ()
    behaviour: str | None = None
    tags: tuple[str, ...] = ()
    known_limitation: bool = False

    def __post_init__(self):
        if sum(map(bool, (self.sql, self.sources, self.behaviour))) != 1:
            raise ValueError(f"{self.id}: exactly one of sql, sources, behaviour")
        if self.behaviour not in (None, "no_data", "refused"):
            raise ValueError(f"{self.id}: unknown behaviour {self.behaviour}")


@dataclass
class Reply:
    """What the answerer gave back."""

    route: str
    rows: list[tuple] | None = None
    sources: tuple[tuple[str, str | None], ...] = ()
    refused: str | None = None
    trace: dict = field(default_factory=dict)


def judge(case: Case, reply: Reply, expected: list[tuple] | None, k: int = 4) -> tuple[bool, str, dict]:
    """(passed, reason, metrics)."""
    if case.behaviour == "refused":
        return bool(reply.refused), reply.refused or "it was answered", {}
    if reply.refused:
        return False, f"refused: {reply.refused}", {}
    if case.behaviour == "no_data":
        empty = not reply.rows or all(c is None or c == 0 for r in reply.rows for c in r)
        return empty, "no data" if empty else f"{len(reply.rows)} rows", {}
    if case.sources:
        ranked = list(reply.sources)
        return hit_at(case.sources, ranked, k), "sources", {"hit": hit_at(case.sources, ranked, k), "rr": reciprocal_rank(case.sources, ranked)}
    passed, why = compare(expected or [], reply.rows or [], case.spec)
    return passed, why, {}


class ExpectedResults:
    """Results of the reference SQL, kept under a hash of the SQL and a signal of the data: rows and sums, not only its first and last day."""

    def __init__(self, spark: SparkSession, path: str, signal: str, most_rows: int = 100_000):
        self.spark, self.path, self.signal, self.most_rows = spark, path, signal, most_rows

    def of(self, sql: str) -> list[tuple]:
        key = hashlib.sha256(f"{self.signal}\0{sql}".encode()).hexdigest()
        held = json.loads(read_text(self.spark, self.path) or "{}")
        if key not in held:
            rows = self.spark.sql(sql).limit(self.most_rows + 1).collect()
            if len(rows) > self.most_rows:
                raise ValueError(f"the reference SQL gives more than {self.most_rows} rows; it cannot be a case's result")
            held[key] = [[c if isinstance(c, (int, float, str, bool, type(None))) else str(c) for c in r] for r in rows]
            write_text(self.spark, self.path, json.dumps(held))
        return [tuple(r) for r in held[key]]


class DayBudget:
    """Calls left of a day, kept in a file so that runs of one day share them. Days change at midnight, Pacific time."""

    def __init__(self, path: str, per_day: int, now: Callable[[], datetime] | None = None):
        self.path, self.per_day = Path(path), per_day
        self.now = now or (lambda: datetime.now(ZoneInfo("America/Los_Angeles")))

    def used(self) -> int:
        held = json.loads(self.path.read_text()) if self.path.exists() else {}
        return held.get("calls", 0) if held.get("day") == self.now().date().isoformat() else 0

    def left(self) -> int:
        return max(0, self.per_day - self.used())

    def spend(self) -> None:
        if not self.left():
            raise RuntimeError("the day's calls are used up")
        self.path.write_text(json.dumps({"day": self.now().date().isoformat(), "calls": self.used() + 1}))


def calls_needed(cases: Sequence[Case], done: Sequence[str], undecided: Callable[[str], bool] = lambda question: False) -> int:
    """Most calls that the open cases can make: one to route where phrases do not decide, two to write SQL (the second repairs), one to
    tell the answer. Conceptual and refused cases are told from passages or not at all."""
    open_cases = [c for c in cases if c.id not in set(done)]
    return sum(undecided(c.question) + (3 if c.sql or c.behaviour else 1) for c in open_cases)


class ReplyCache:
    """Replies of a text generator by prompt, so that a run can be replayed without calls."""

    def __init__(self, path: str, generate: Callable[[str], str], per_minute: int | None = None, budget: DayBudget | None = None, clock=time.monotonic, sleep=time.sleep):
        self.path, self.generate, self.gap, self.budget, self.clock, self.sleep = Path(path), generate, 60 / per_minute if per_minute else 0, budget, clock, sleep
        self.held = json.loads(self.path.read_text()) if self.path.exists() else {}
        self.hits = self.calls = 0
        self.last = None

    def __call__(self, prompt: str) -> str:
        key = hashlib.sha256(prompt.encode()).hexdigest()
        if key in self.held:
            self.hits += 1
            return self.held[key]
        if self.budget is not None:
            self.budget.spend()
        if self.last is not None and (wait := self.last + self.gap - self.clock()) > 0:
            self.sleep(wait)
        self.last, self.calls = self.clock(), self.calls + 1
        self.held[key] = self.generate(prompt)
        self.path.write_text(json.dumps(self.held))
        return self.held[key]


def run(cases: Sequence[Case], answer: Callable[[str], Reply], expected: Callable[[str], list[tuple]], out: str) -> list[dict]:
    """Answer and judge every case not in ``out`` yet (one JSON line each, the last line of a case counts); an error fails its case only."""
    path = Path(out)
    done = {}
    if path.exists():
        for line in path.read_text().splitlines():
            record = json.loads(line)
            done[record["id"]] = record
    with path.open("a") as f:
        for case in cases:
            if case.id in done:
                continue
            try:
                reply = answer(case.question)
                passed, reason, metrics = judge(case, reply, expected(case.sql) if case.sql else None)
                route, trace = reply.route, reply.trace
            except Exception as e:  # noqa: BLE001
                passed, reason, metrics, route, trace = False, type(e).__name__, {}, None, {}
            done[case.id] = {"id": case.id, "tags": case.tags, "known_limitation": case.known_limitation, "kind": "sql" if case.sql else "sources" if case.sources else case.behaviour, "route_ok": route == case.route, "passed": passed, "reason": reason, "metrics": metrics, "trace": trace}
            f.write(json.dumps(done[case.id], default=str) + "\n")
            f.flush()
    return [done[c.id] for c in cases]


def percentile(values: Sequence[float], q: float) -> float:
    """By linear interpolation between neighbours."""
    ordered, at = sorted(values), (len(values) - 1) * q
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def report(results: Sequence[dict], expected_ids: Sequence[str] = ()) -> dict:
    """Rates over the cases that are no known limitation; latencies, lint, partitions, tokens and retries over all. A run that lacks
    an expected case is incomplete."""
    counted = [r for r in results if not r["known_limitation"]]

    def share(kind):
        mine = [r for r in counted if r["kind"] == kind]
        return {"passed": sum(r["passed"] for r in mine), "of": len(mine)}

    ranks = [r["metrics"]["rr"] for r in counted if "rr" in r["metrics"]]
    traces = [r["trace"] for r in results]
    linted = [t["findings"] for t in traces if t.get("findings") is not None]
    parts = [n for t in traces for n in (t.get("partitions") or {}).values()]
    calls = [c for t in traces for s in t.get("spans", []) for c in s.get("provider_calls", [])]
    spans: dict[str, list[float]] = {}
    for r in results:
        for s in r["trace"].get("spans", []):
            spans.setdefault(s["name"], []).append(s["duration_ms"])
    return {
        "route": {"passed": sum(r["route_ok"] for r in counted if r["kind"] != "refused"), "of": sum(r["kind"] != "refused" for r in counted)},
        **{k: share(k) for k in ("sql", "sources", "no_data", "refused")},
        "mrr": statistics.mean(ranks) if ranks else None,
        "failures": dict(Counter(r["reason"] for r in results if not r["passed"])),
        "spans_ms": {k: {"n": len(v), "p50": round(percentile(v, 0.5), 1), "p95": round(percentile(v, 0.95), 1)} for k, v in spans.items()},
        "lint": {"passed": sum(not f for f in linted), "of": len(linted)},
        "partitions": statistics.median(parts) if parts else None,
        "tokens": {k: sum(c.get(k) or 0 for c in calls) for k in ("prompt", "output", "thought")},
        "retries": sum(c.get("retries") or 0 for c in calls),
        "incomplete": bool(expected_ids) and not set(expected_ids) <= {r["id"] for r in results},
    }


def markdown(summary: dict) -> str:
    lines = ["| measure | passed | of |", "|---|---|---|"]
    lines += [f"| {k} | {v['passed']} | {v['of']} |" for k, v in summary.items() if isinstance(v, dict) and "of" in v]
    if summary["mrr"] is not None:
        lines.append(f"\nMean reciprocal rank: {summary['mrr']:.3f}")
    if summary["spans_ms"]:
        lines += ["", "| span | n | p50 ms | p95 ms |", "|---|---|---|---|", *[f"| {k} | {v['n']} | {v['p50']} | {v['p95']} |" for k, v in summary["spans_ms"].items()]]
    if summary["incomplete"]:
        lines += ["", "The run is incomplete."]
    lines += ["", "| failure | cases |", "|---|---|", *[f"| {k} | {v} |" for k, v in summary["failures"].items()]] if summary["failures"] else []
    return "\n".join(lines)


def as_json(case: Case) -> str:
    return json.dumps(asdict(case))
