"""Audit of load runs and stored profiles: append-only events, the latest one counts."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.sources.scan import last_wins

SCHEMA = "run_id string, at timestamp, status string, source string, rows_loaded long, rows_rejected long, error string"
ERROR_CHARS = 2000


class RunLog:
    """Events of load runs under a shared path; written apart from the load, so that a failed load leaves its trace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, run_id: str, status: str, source=None, loaded=None, rejected=None, error=None) -> None:
        row = [(run_id, datetime.now(timezone.utc), status, source, loaded, rejected, error[:ERROR_CHARS] if error else None)]
        self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, source: str) -> str:
        run_id = str(uuid.uuid4())
        self._append(run_id, "running", source)
        return run_id

    def finish(self, run_id: str, loaded: int, rejected: int) -> None:
        self._append(run_id, "succeeded", loaded=loaded, rejected=rejected)

    def fail(self, run_id: str, error: str) -> None:
        self._append(run_id, "failed", error=error)

    def latest(self) -> DataFrame:
        events = self.spark.read.schema(SCHEMA).parquet(self.path)
        first = events.where(F.col("source").isNotNull()).groupBy("run_id").agg(F.max("source").alias("from_source"), F.min("at").alias("started_at"))
        return last_wins(events.drop("source"), ["run_id"], ["at"]).join(first, "run_id", "left")


class ProfileSnapshot:
    """A measured profile kept in a small file with the key it was measured under; any other key or version measures again."""

    VERSION = 1

    def __init__(self, path: str):
        self.path = Path(path)

    def read(self, key: dict) -> dict | None:
        try:
            held = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return None
        return held["profile"] if held.get("version") == self.VERSION and held.get("key") == key else None

    def write(self, key: dict, profile: dict) -> None:
        fresh = self.path.with_suffix(".new")
        fresh.write_text(json.dumps({"version": self.VERSION, "key": key, "profile": profile}))
        fresh.replace(self.path)
