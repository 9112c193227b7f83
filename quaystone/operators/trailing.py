"""Totals and averages over trailing periods, days without a row included."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, entity: str, day: str, measures: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """For every entity and calendar day of the table's span: trailing totals and averages per day, by block decomposition.

    Rows are summed by (entity, day); after the shuffle by entity, one zero row per day fills the calendar without a join. The
    days are cut into blocks as long as the window. A prefix sum runs from the block's start, a suffix sum to its end; the window
    that ends on a day is the prefix there plus the suffix, ``w - 1`` days earlier, of the block before. Nothing is subtracted, so
    sums of floating point numbers stay exact to rounding. All windows share one partitioning by entity, whose groups are bounded
    by the days of the span because the table was summed first.

    Result: entity, day, ``has_row``, and per measure and window ``<measure>_<w>d`` (total) and ``<measure>_<w>d_avg`` (per
    calendar day; at the start of the span over the days that exist, given in ``days_<w>d``). Defined cases: rows with null
    entity or day are left out; null measures count as zero; repeated rows of a day are added up; an empty table gives no rows.
    Names beginning with ``__qs_`` are never taken from the input.
    """
    e, d = F.col(f"`{entity}`"), F.col(f"`{day}`").cast("date")
    rows = df.where(e.isNotNull() & d.isNotNull()).select(e.alias("__qs_e"), d.alias("__qs_d"), *[F.col(f"`{m}`").alias(f"__qs_m{i}") for i, m in enumerate(measures)])
    first, last = rows.agg(F.min("__qs_d"), F.max("__qs_d")).first()
    if first is None:
        first = last = date(1970, 1, 1)
    sums = [F.coalesce(F.sum(f"__qs_m{i}"), F.lit(0)).alias(f"__qs_m{i}") for i in range(len(measures))]
    daily = rows.groupBy("__qs_e", "__qs_d").agg(*sums)
    # One array per entity, no longer than the span, is filled up to the calendar after the shuffle by entity; the steps below keep to it.
    names = ["__qs_d", *[f"__qs_m{i}" for i in range(len(measures))], "__qs_n"]
    found = F.collect_list(F.struct(*names[:-1], F.lit(1).alias("__qs_n")))
    zeros = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda x: F.struct(x.alias("__qs_d"), *[F.lit(0).cast(daily.schema[n].dataType).alias(n) for n in names[1:-1]], F.lit(0).alias("__qs_n")))
    filled = daily.repartition("__qs_e").groupBy("__qs_e").agg(found.alias("__qs_found")).select("__qs_e", F.explode(F.concat("__qs_found", zeros)).alias("__qs_x")).select("__qs_e", "__qs_x.*")
    dense = filled.groupBy("__qs_e", "__qs_d").agg(*[F.sum(n).alias(n) for n in names[1:-1]], F.max("__qs_n").alias("__qs_n"))
    out = dense.withColumn("__qs_at", F.datediff("__qs_d", F.lit(first)))
    by_entity = Window.partitionBy("__qs_e").orderBy("__qs_at")
    columns = [F.col("__qs_e").alias(entity), F.col("__qs_d").alias(day), (F.col("__qs_n") > 0).alias("has_row")]
    for w in windows:
        out = out.withColumn(f"__qs_b{w}", F.floor(F.col("__qs_at") / w))
        block = Window.partitionBy("__qs_e", f"__qs_b{w}").orderBy("__qs_at")
        for i in range(len(measures)):
            out = out.withColumn(f"__qs_pre{w}_{i}", F.sum(f"__qs_m{i}").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            out = out.withColumn(f"__qs_suf{w}_{i}", F.sum(f"__qs_m{i}").over(block.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    for w in windows:
        days = F.least(F.lit(w), F.col("__qs_at") + 1)
        columns.append(days.cast("int").alias(f"days_{w}d"))
        for i, m in enumerate(measures):
            # On the last day of a block the prefix is the whole window.
            whole = F.pmod(F.col("__qs_at"), F.lit(w)) == w - 1
            early = F.lag(f"__qs_suf{w}_{i}", w - 1).over(by_entity)
            first_block = F.col(f"__qs_b{w}") == 0
            total = F.when(whole | first_block, F.col(f"__qs_pre{w}_{i}")).otherwise(F.col(f"__qs_pre{w}_{i}") + early)
            columns += [total.alias(f"{m}_{w}d"), (total / days).cast("double").alias(f"{m}_{w}d_avg")]
    return out.select(*columns)
