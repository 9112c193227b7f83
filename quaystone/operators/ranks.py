"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.session import cut


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    """groups, one column per probability (linear interpolation between neighbours), ``n``: no group is gathered in one task.

    Equal values are counted first, combined before the shuffle. The counts are sorted over all tasks by (group, value); a row's rank
    is the sum of its group's counts in the ranges before, of which there is one row per range and group, and of those before it in
    its own range. The rows that hold the wanted ranks are picked by one aggregation. Null and NaN values are left out; a group
    without any other has no row; null groups are groups.
    """
    v = F.col(f"`{value}`").cast("double")
    names_in = [f"__qs_g{i}" for i in range(len(groups))]
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names_in)], v.alias("__qs_v"))
    counted = rows.groupBy(*names_in, "__qs_v").agg(F.count(F.lit(1)).alias("__qs_n"))
    # Cut, so that a row keeps its range even if a task runs again.
    ranged = cut(counted.repartitionByRange(*names_in, "__qs_v").withColumn("__qs_r", F.spark_partition_id()))
    before = Window.partitionBy(*names_in).orderBy("__qs_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*names_in, "__qs_r").agg(F.sum("__qs_n").alias("__qs_in"))
    ranges = ranges.select(*[F.col(n).alias(f"{n}_") for n in names_in], F.col("__qs_r").alias("__qs_r_"), F.coalesce(F.sum("__qs_in").over(before), F.lit(0)).alias("__qs_before"), F.sum("__qs_in").over(Window.partitionBy(*names_in)).alias("__qs_all"))
    own = Window.partitionBy("__qs_r", *names_in).orderBy("__qs_v").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__qs_r") == F.col("__qs_r_")
    for n in names_in:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    placed = ranged.withColumn("__qs_own", F.coalesce(F.sum("__qs_n").over(own), F.lit(0))).join(ranges, same)
    first = F.col("__qs_before") + F.col("__qs_own")

    def held(rank):
        return F.max(F.when((rank >= first) & (rank < first + F.col("__qs_n")), F.col("__qs_v")))

    picked = []
    for i, p in enumerate(probabilities):
        low = F.floor((F.col("__qs_all") - 1) * F.lit(float(p)))
        picked += [held(low).alias(f"__qs_low{i}"), held(F.least(low + 1, F.col("__qs_all") - 1)).alias(f"__qs_high{i}")]
    out = placed.groupBy(*names_in).agg(*picked, F.max("__qs_all").alias("n"))
    columns = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        at = (F.col("n") - 1) * F.lit(float(p))
        columns.append((F.col(f"__qs_low{i}") + (F.col(f"__qs_high{i}") - F.col(f"__qs_low{i}")) * (at - F.floor(at))).alias(name))
    return out.select(*[F.col(n).alias(g) for n, g in zip(names_in, groups)], *columns, "n")
