"""Percentiles of very large numeric columns from mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import rank_error

#: Size of the lowest compactor: 0.68 % of rank error at 99 % confidence, about 9 KB a sketch.
K = 400


def usable(value: Column) -> Column:
    """A duration that can be ranked: not null, not NaN, finite and not negative."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))


def sketches(df: DataFrame, groups: Sequence[str], value: str, k: int = K, keep: Column | None = None) -> DataFrame:
    """One sketch per group: a hierarchy of randomised compactors, each of which sorts its buffer and passes every other value on.

    Built by Spark's KLL aggregate inside the JVM: every task compacts its own rows and the partial sketches, a few KB each, are
    merged levelwise after the shuffle, so a hot group is never gathered. Result: groups, ``sketch``, ``n`` (ranked values),
    ``rejected``. Defined cases: null groups are groups; values that are null, NaN, infinite or negative are counted in
    ``rejected`` and not ranked; a group without a usable value has a null sketch; an empty table gives no rows.
    """
    ok = usable(F.col(f"`{value}`")) if keep is None else keep
    clean = F.when(ok, F.col(f"`{value}`").cast("double"))
    rows = df.select(*[F.col(f"`{g}`").alias(g) for g in groups], clean.alias("__qs_v"))
    out = rows.groupBy(*groups).agg(F.kll_sketch_agg_double("__qs_v", k).alias("sketch"), F.count("__qs_v").alias("n"), F.sum(F.when(F.col("__qs_v").isNull(), 1).otherwise(0)).alias("rejected"))
    return out.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def combine(parts: DataFrame, groups: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of partitions, days or tables combined per group; the rank error stays that of ``k``."""
    merged = parts.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))
    return merged.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def percentiles(parts: DataFrame, probabilities: Sequence[float], k: int = K) -> DataFrame:
    """Adds ``p<percent>`` columns and the ``rank_error`` that holds with 99 % probability; null where nothing was ranked."""
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    got = parts.withColumn("__qs_q", F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", asked)))
    names = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    return got.select("*", *[F.col("__qs_q")[i].alias(n) for i, n in enumerate(names)], F.lit(rank_error(k)).alias("rank_error")).drop("__qs_q")


def rank_of(parts: DataFrame, value: Column) -> DataFrame:
    """Adds ``rank``: the share of the group's values up to ``value``, within the same error."""
    return parts.withColumn("rank", F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_rank_double("sketch", value.cast("double"))))
