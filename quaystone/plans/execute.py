"""Estimates, the scan ceiling, and execution under a timeout."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quaystone.plans.guard import Policy, SafeQuery, _seq, capped


class QueryFailed(RuntimeError):
    """Only the kind of failure, never its text: the text may hold data."""


class QueryTooExpensive(RuntimeError):
    """The plan would scan more than the policy admits."""


@dataclass(frozen=True)
class Estimate:
    result_bytes: int
    scan_bytes: int
    files: int
    partitions_pruned: bool
    #: Per table: the partitions that its scans read.
    partitions: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class QueryResult:
    columns: tuple[str, ...]
    rows: list[tuple]
    truncated: bool
    elapsed_ms: float
    near_timeout: bool = False
    notes: tuple[str, ...] = field(default=())


def _leaves(plan):
    kids = _seq(plan.children().toSeq())
    if not kids:
        yield plan
    for k in kids:
        yield from _leaves(k)


def estimate(df: DataFrame) -> Estimate:
    """Catalyst's own statistics of the optimised plan: bytes of the leaves it scans, and of the result."""
    q = df._jdf.queryExecution()
    plan = q.optimizedPlan()
    scan = sum(int(str(leaf.stats().sizeInBytes())) for leaf in _leaves(plan))
    text = q.executedPlan().toString()
    parts: dict[str, int] = {}
    for leaf in _leaves(plan):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.catalogTable().isDefined():
            name = leaf.catalogTable().get().identifier().table()
            parts[name] = parts.get(name, 0) + _partitions(leaf.relation())
    return Estimate(int(str(plan.stats().sizeInBytes())), scan, len(df.inputFiles()), bool(re.search(r"PartitionFilters: \[[^\]]", text)), parts)


def _partitions(relation) -> int:
    """Folders of a partitioned table that are left after pruning; 1 for a table that is not."""
    files = relation.location().inputFiles()
    return len({f.rsplit("/", 1)[0] for f in files}) if relation.partitionSchema().length() else 1


def check_cost(df: DataFrame, policy: Policy) -> Estimate | None:
    """The estimate, or None where there is none: a plan that cannot be estimated never trips the ceiling."""
    try:
        found = estimate(df)
    except Exception:  # noqa: BLE001
        return None
    if policy.max_scan_bytes is not None and found.scan_bytes > policy.max_scan_bytes:
        raise QueryTooExpensive(f"would scan {found.scan_bytes} bytes, {policy.max_scan_bytes} are admitted")
    return found


def plain(value: Any) -> Any:
    """A cell as JSON can hold it."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def execute(spark: SparkSession, query: SafeQuery, policy: Policy) -> QueryResult:
    """Collect a validated query under the row cap; its jobs are cancelled by tag when the time is over.

    ``truncated`` compares with the cap, not with the query's own limit.
    """
    tag = f"quaystone-{uuid.uuid4()}"
    sc = spark.sparkContext
    over = threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(policy.timeout_s, stop)
    began = time.monotonic()
    sc.addJobTag(tag)
    try:
        df = capped(spark, query)
        timer.start()
        rows = [tuple(r) for r in df.collect()]
    except Exception as e:
        raise QueryFailed("Timeout" if over.is_set() else type(e).__name__) from None
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    elapsed = time.monotonic() - began
    return QueryResult(tuple(df.columns), rows, len(rows) >= query.limit, elapsed * 1000, elapsed > 0.8 * policy.timeout_s)
