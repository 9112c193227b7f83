"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.hashing import row_hash
from quaystone.session import cut, measured_join, sizes_of


#: Hashes below, versions above: places of a number of 38 digits.
_HASHES = Decimal(2**64)
#: More microseconds than any date lies before 1970.
_EARLIEST = 10**17


def _ranked_hash(df: DataFrame, compare: Sequence[str], version: str | None) -> Column:
    """Version and row hash as one number, so that the greatest is the latest row: a number can be aggregated in place, without sorting
    the rows before the shuffle. Versions are times, dates or whole numbers of up to 32 bits; null is the oldest."""
    if version is None:
        rank = F.lit(0)
    elif isinstance(df.schema[version].dataType, (T.TimestampType, T.DateType)):
        rank = F.unix_micros(F.col(f"`{version}`").cast("timestamp"))
    elif isinstance(df.schema[version].dataType, (T.TimestampNTZType, T.ByteType, T.ShortType, T.IntegerType)):
        rank = F.unix_micros(F.col(f"`{version}`").cast("timestamp")) if isinstance(df.schema[version].dataType, T.TimestampNTZType) else F.col(f"`{version}`").cast("long")
    else:
        raise TypeError(f"{version} is no time, date or whole number of up to 32 bits")
    above = F.coalesce(rank.cast("decimal(20,0)") + F.lit(Decimal(_EARLIEST)), F.lit(Decimal(0))).cast("decimal(18,0)") * F.lit(_HASHES)
    return (above + (row_hash(df, compare)[0].cast("decimal(20,0)") + F.lit(Decimal(2**63)))).cast("decimal(38,0)")


def _hash_of(ranked: Column) -> Column:
    return ranked % F.lit(_HASHES)


def snapshot_changes(df: DataFrame, snapshot: str, keys: Sequence[str], compare: Sequence[str], version: str | None = None) -> DataFrame:
    """Which keys were added, removed or changed between each delivery and the one before it.

    Every row is tagged twice, as the later side of its own delivery and as the earlier side of the next one; one aggregation by
    (later delivery, key) keeps per side the row hash of the latest version and classifies from the two hashes. Partial
    aggregation runs before the shuffle, so repeated rows of a hot key never travel. The hashes have 64 bits: of changes, one in 10^19
    goes unseen.

    Result: ``snapshot`` (the later one), the keys, ``change_kind`` in added, removed, changed. Defined cases: deliveries are
    neighbours in the order of existing numbers; a row with null snapshot or a null key is no record; null compares equal to null;
    ``version`` null counts as oldest; equal versions of one key are settled by the greater hash, so the result does not depend on
    order; one delivery or an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    present = df.where(F.col(f"`{snapshot}`").isNotNull())
    for k in keys:
        present = present.where(F.col(f"`{k}`").isNotNull())
    rows = present.select(F.col(f"`{snapshot}`").alias("__qs_at"), *[F.col(f"`{k}`").alias(f"__qs_k{i}") for i, k in enumerate(keys)], _ranked_hash(df, compare, version).alias("__qs_row"))
    # One row per delivery: the calendar of deliveries, not data.
    order = Window.orderBy("__qs_own")
    calendar = present.select(F.col(f"`{snapshot}`").alias("__qs_own")).distinct()
    calendar = cut(calendar.select("__qs_own", F.lead("__qs_own").over(order).alias("__qs_next"), F.lag("__qs_own").over(order).isNull().alias("__qs_first")))
    names = [f"__qs_k{i}" for i in range(len(keys))]
    sides = F.array(
        F.struct(F.when(~F.col("__qs_first"), F.col("__qs_own")).alias("pair"), F.lit(True).alias("later")),
        F.struct(F.col("__qs_next").alias("pair"), F.lit(False).alias("later")),
    )
    # Measured, so that the rows need no shuffle to meet it.
    dated = measured_join(rows, calendar, "__qs_at", "__qs_own", "inner", sizes_of(calendar)[0], F.struct(*names))
    tagged = dated.select(*names, "__qs_row", F.explode(sides).alias("__qs_side")).where(F.col("__qs_side.pair").isNotNull())
    both = tagged.groupBy(F.col("__qs_side.pair").alias("__qs_pair"), *names).agg(
        F.max(F.when(F.col("__qs_side.later"), F.col("__qs_row"))).alias("new"),
        F.max(F.when(~F.col("__qs_side.later"), F.col("__qs_row"))).alias("old"),
    )
    kind = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(_hash_of(F.col("old")) != _hash_of(F.col("new")), F.lit("changed"))
    )
    return (
        both.withColumn("__qs_kind", kind)
        .where(F.col("__qs_kind").isNotNull())
        .select(F.col("__qs_pair").alias(snapshot), *[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("__qs_kind").alias("change_kind"))
    )
