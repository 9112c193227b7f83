"""Writes and merges over plain Parquet: upsert, scoped replacement, promotion, corpus synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.schema import EXPORT, GRAIN
from quaystone.sources.scan import Scope, last_wins


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after an upsert, with ``outcome`` kept, updated or inserted; rows absent from ``new`` stay."""
    columns = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*columns).alias("__qs_old"))
    b = new.select(*key, F.struct(*columns).alias("__qs_new"))
    both = a.join(b, list(key), "full")
    outcome = F.when(F.col("__qs_new").isNull(), "kept").when(F.col("__qs_old").isNull(), "inserted").otherwise("updated")
    return both.select(*key, F.coalesce("__qs_new", "__qs_old").alias("__qs_v"), outcome.alias("outcome")).select(*key, *[F.col(f"__qs_v.{c}").alias(c) for c in columns], "outcome")


def replace_scope(old: DataFrame, new: DataFrame, scope: Scope) -> DataFrame:
    """The table after its days in scope were replaced by those of ``new``; days of the scope that ``new`` lacks are gone."""
    return old.where(~scope.column()).unionByName(new.where(scope.column()))


def promote(staged: DataFrame, scope: Scope = Scope(), order: Sequence[str] = ()) -> DataFrame:
    """Fact rows of valid staged rows in scope: ``measured_arrivals`` derived, the last landed row of a grain counts."""
    rows = staged.where(scope.column())
    if order:
        rows = last_wins(rows, list(GRAIN), list(order))
    measured = F.when(F.col("punctual_arrivals").isNull(), 0).otherwise(1).cast("short")
    return rows.select(*EXPORT.columns, measured.alias("measured_arrivals"))


def sync(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Positions of a chunk store against a corpus: ``outcome`` inserted, updated (hash differs), unchanged or deleted, and the new hash.

    One full outer join on (doc_id, chunk_index). Repeated positions in the corpus come out as ``duplicate`` once per repeat.
    """
    position = ["doc_id", "chunk_index"]
    many = corpus.groupBy(*position).agg(F.count(F.lit(1)).alias("times"), F.max("content_hash").alias("new_hash"))
    both = stored.select(*position, F.col("content_hash").alias("old_hash"), F.lit(True).alias("here")).join(many, position, "full")
    outcome = (
        F.when(F.col("times").isNull(), "deleted").when(F.col("times") > 1, "duplicate").when(F.col("here").isNull(), "inserted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated").otherwise("unchanged")
    )
    return both.select(*position, outcome.alias("outcome"), "new_hash")


def month_partitions(spark: SparkSession, first, last) -> DataFrame:
    """partition_name and half-open bounds of every month from first to last day; days outside fail ``outside``."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"), F.expr("interval 1 month"))).alias("start_day"))
    return months.select(F.date_format("start_day", "'p'yyyy_MM").alias("partition_name"), "start_day", F.add_months("start_day", 1).alias("end_day"))


def outside(df: DataFrame, first, last) -> DataFrame:
    """Rows no month partition takes; there is no default partition."""
    low, high = F.trunc(F.lit(first).cast("date"), "month"), F.add_months(F.trunc(F.lit(last).cast("date"), "month"), 1)
    return df.where((F.col("date_key") < low) | (F.col("date_key") >= high) | F.col("date_key").isNull())


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write beside the target, then swap by renaming, so that readers see the old table or the new one, never half of one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path + tail) for tail in ("", ".new", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)


def load_fact(staged_flags: DataFrame, current: DataFrame | None, scope: Scope, policy: str = "fail") -> tuple[DataFrame | None, DataFrame]:
    """(new fact or None, rejected rows). Only rows in scope are judged and promoted. ``fail`` publishes nothing if a row is rejected,
    ``skip`` leaves the rejected rows out; either way they are returned for quarantine."""
    from quaystone.operators.quality import RULES, valid

    inside = staged_flags.where(scope.column() | F.col("date_key").isNull())
    bad = inside.where(" OR ".join(RULES))
    if policy == "fail" and bad.limit(1).count():
        return None, bad
    fresh = promote(valid(inside), scope)
    return (fresh if current is None else replace_scope(current, fresh, scope)), bad
