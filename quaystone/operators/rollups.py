"""Exact daily rollups, their freshness, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("row_count", "stop_events", "measured_arrivals", "punctual_arrivals")


def rate(punctual: str = "punctual_arrivals", measured: str = "measured_arrivals") -> Column:
    """The punctuality ratio of sums: null where nothing was measured, never a mean of ratios."""
    return F.sum(punctual).cast("double") / F.nullif(F.sum(measured), F.lit(0))


def rollup(fact: DataFrame, key: str) -> DataFrame:
    """Daily sums by a key. Combined before the shuffle; sums over it at any coarser grain equal those of the fact."""
    return fact.groupBy("date_key", key).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("stop_events").cast("long").alias("stop_events"),
        F.sum("measured_arrivals").cast("long").alias("measured_arrivals"),
        F.coalesce(F.sum("punctual_arrivals"), F.lit(0)).cast("long").alias("punctual_arrivals"),
    )


def coarser(roll: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return roll.groupBy(*by).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def difference(fact: DataFrame, roll: DataFrame, key: str) -> DataFrame:
    """Rows of either side that the other lacks or has otherwise: empty when the rollup is exact."""
    built, kept = rollup(fact, key), roll.select("date_key", key, *[F.col(m).cast("long").alias(m) for m in MEASURES])
    return built.exceptAll(kept).withColumn("side", F.lit("fact")).unionByName(kept.exceptAll(built).withColumn("side", F.lit("rollup")))


def freshness(fact: DataFrame, roll: DataFrame) -> DataFrame:
    """One row: last days and sums of both sides and whether the rollup is fresh. An empty fact is fresh; sums are compared as well as
    dates, so that a reload of an earlier day is noticed."""
    f = fact.agg(F.max("date_key").alias("fact_last"), F.sum("stop_events").alias("fact_events"), F.count(F.lit(1)).alias("fact_rows"))
    r = roll.agg(F.max("date_key").alias("rollup_last"), F.sum("stop_events").alias("rollup_events"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rollup_rows"))
    fresh = (F.col("fact_rows") == 0) | (F.col("fact_last").eqNullSafe(F.col("rollup_last")) & F.col("fact_events").eqNullSafe(F.col("rollup_events")) & (F.col("fact_rows") == F.col("rollup_rows")))
    return f.join(r).withColumn("is_fresh", fresh)


def activity(stations: DataFrame, fact: DataFrame) -> DataFrame:
    """Every station with its stop events, 0 without any: the fact is summed first, so the join meets one row per station."""
    events = fact.groupBy("station_key").agg(F.sum("stop_events").cast("long").alias("__qs_events"))
    return stations.drop("observed_stop_events").join(events, "station_key", "left").withColumn("observed_stop_events", F.coalesce("__qs_events", F.lit(0))).drop("__qs_events")


def coverage_profile(fact: DataFrame) -> DataFrame:
    """Exact extent of the facts in one pass."""
    return fact.agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.min("date_key").alias("first_day"),
        F.max("date_key").alias("last_day"),
        F.countDistinct("date_key").alias("days"),
        F.countDistinct("station_key").alias("stations"),
    )
