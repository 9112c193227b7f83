"""Set-based validation of a landed batch against the star."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.schema import GRAIN, KEYS

RULES = ("null_keys", "duplicate_grain", "orphan_date", "orphan_station", "orphan_relation")


def any_null(columns=KEYS) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def flagged(batch: DataFrame, dates: DataFrame, stations: DataFrame, relations: DataFrame) -> DataFrame:
    """The batch with one boolean per rule.

    A null key breaks ``null_keys`` only; every member of a repeated grain is flagged. The dimensions join by Spark's own measure of
    their size. Repeats are counted by an aggregation over the grain, combined before the shuffle, and only grains that repeat come
    back; no window sorts the batch.
    """
    out = batch.withColumn("null_keys", any_null())
    repeated = out.where(~F.col("null_keys")).groupBy(*GRAIN).count().where("count > 1").select(*GRAIN, F.lit(True).alias("__qs_many"))
    out = out.join(repeated, list(GRAIN), "left").withColumn("duplicate_grain", F.coalesce("__qs_many", F.lit(False)) & ~F.col("null_keys"))
    for rule, key, dim in (("orphan_date", "date_key", dates), ("orphan_station", "station_key", stations), ("orphan_relation", "relation_key", relations)):
        known = dim.select(F.col(key).alias("__qs_known")).distinct()
        out = out.join(known, F.col(key) == F.col("__qs_known"), "left").withColumn(rule, F.col(key).isNotNull() & F.col("__qs_known").isNull()).drop("__qs_known")
    return out.drop("__qs_many")


def rule_counts(flags: DataFrame) -> DataFrame:
    """rule, rows_failed, in one pass over the flags."""
    one = flags.agg(*[F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(r) for r in RULES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rows_failed")) for r in RULES])).alias("x")).select("x.*")


def samples(flags: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` keys of each broken rule, the first in key order; one pass over the flags, numbered per rule within a bounded top-n."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS])
    broken = flags.select(key.alias("key"), F.explode(F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())).alias("rule"))
    # Spark cuts every task's rows to the first n of a rule before the shuffle (WindowGroupLimit), so no rule is gathered.
    return broken.withColumn("__qs_r", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where(F.col("__qs_r") <= n).drop("__qs_r")


def valid(flags: DataFrame) -> DataFrame:
    return flags.where(~reduce(lambda a, b: a | b, [F.col(r) for r in RULES])).drop(*RULES)


def integrity(fact: DataFrame, dates: DataFrame, stations: DataFrame, relations: DataFrame) -> DataFrame:
    """orphan_rows: facts with a reference that does not resolve; a row that is orphaned twice counts once."""
    out = fact.select("date_key", "station_key", "relation_key")
    for key, dim in (("date_key", dates), ("station_key", stations), ("relation_key", relations)):
        known = dim.select(F.col(key).alias(f"__qs_{key}")).distinct()
        out = out.join(known, F.col(key) == F.col(f"__qs_{key}"), "left")
    lost = reduce(lambda a, b: a | b, [F.col(k).isNotNull() & F.col(f"__qs_{k}").isNull() for k in ("date_key", "station_key", "relation_key")])
    return out.agg(F.coalesce(F.sum(lost.cast("long")), F.lit(0)).alias("orphan_rows"))
