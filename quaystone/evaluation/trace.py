"""Spans of a request, one JSON line each, and their statistics."""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators.ranks import exact_percentiles

_current: ContextVar[dict | None] = ContextVar("quaystone_trace", default=None)
_log = logging.getLogger("quaystone.trace")


def sink(path: str, megabytes: int = 5, backups: int = 3) -> None:
    """Send traces to a rotating file of JSON lines; safe to repeat."""
    _log.setLevel(logging.INFO)
    _log.propagate = False
    if not any(getattr(h, "baseFilename", None) == path for h in _log.handlers):
        _log.addHandler(RotatingFileHandler(path, maxBytes=megabytes * 1_000_000, backupCount=backups, encoding="utf-8"))


@contextmanager
def traced(kind: str, question: str | None = None) -> Iterator[dict]:
    """A request; the question is kept as hash and length only."""
    record = {"request_id": uuid.uuid4().hex, "kind": kind, "started_at": datetime.now(timezone.utc).isoformat(), "route": None, "error_class": None, "error_span": None, "spans": []}
    if question is not None:
        record |= {"question_hash": hashlib.sha256(question.encode()).hexdigest()[:12], "question_length": len(question)}
    token, began = _current.set(record), time.perf_counter()
    try:
        yield record
    except Exception as e:
        record["error_class"] = type(e).__name__
        raise
    finally:
        record["total_ms"] = round((time.perf_counter() - began) * 1000, 1)
        _current.reset(token)
        _log.info(json.dumps(record, default=str))


@contextmanager
def span(name: str) -> Iterator[dict]:
    """A step of the current request; the innermost failing one is named."""
    record, own, began = _current.get(), {"name": name}, time.perf_counter()
    try:
        yield own
    except Exception:
        if record is not None and record["error_span"] is None:
            record["error_span"] = name
        raise
    finally:
        own["duration_ms"] = round((time.perf_counter() - began) * 1000, 1)
        if record is not None:
            record["spans"].append(own)


def annotate(**values) -> None:
    record = _current.get()
    if record is not None:
        record.update(values)


def span_statistics(traces: DataFrame) -> DataFrame:
    """name, p50, p95, spans of finite durations."""
    s = traces.select(F.explode("spans").alias("s")).select("s.name", "s.duration_ms")
    return exact_percentiles(s, ["name"], "duration_ms", (0.5, 0.95), ("p50", "p95")).withColumnRenamed("n", "spans")
