"""Per-key results where a few keys hold most records."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.session import SALTS


#: Items that a frequent-items sketch can track.
MOST_TRACKED = 1_000_000


def heavy_hitters(df: DataFrame, keys: Sequence[str], share: float) -> tuple[dict[str, list], int]:
    """By key column, the values that may hold at least ``share`` of the rows, and the exact number of rows: one scan for all columns.

    Mergeable frequent-items sketches track so many items that their error is below an eighth of the share: no value above the share
    is lost, and at most 2 / share values come back, which bounds what is broadcast later. A share too small for that is refused.
    Null is not a value.
    """
    tracked = max(1_000, math.ceil(16 / share))
    if tracked > MOST_TRACKED:
        raise ValueError(f"a share of {share} needs {tracked} tracked items; the least share is {16 / MOST_TRACKED}")
    k = math.ceil(2 / share)
    rows = df.select(*[F.col(f"`{key}`").alias(f"__qs_k{i}") for i, key in enumerate(keys)])
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(__qs_k{i}, {k}, {max(tracked, k)}) FILTER (WHERE __qs_k{i} IS NOT NULL)").alias(f"top{i}") for i in range(len(keys))]).first()
    return {key: [t["item"] for t in row[f"top{i}"] or [] if t["item"] is not None and t["count"] >= share * row["n"] / 2] for i, key in enumerate(keys)}, row["n"]


def _listed(df: DataFrame, key: str, values: Sequence, name: str) -> DataFrame:
    """The heavy values of a key as a table to broadcast: at most 2 / share rows."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {df.schema[key].dataType.simpleString()}")


def split_by_weight(df: DataFrame, key: str, heavy: Sequence) -> tuple[DataFrame, DataFrame]:
    """The rows of the heavy keys, by a broadcast join with their bounded list, and all other rows, null keys included."""
    listed = F.broadcast(_listed(df, key, heavy, "__qs_heavy"))
    mine = F.col(f"`{key}`") == F.col("__qs_heavy")
    return df.join(listed, mine, "left_semi"), df.join(listed, mine, "left_anti")


def per_keys(df: DataFrame, keys: Sequence[str], partials: dict[str, Column], merges: dict[str, str], share: float = 0.01, salts: int = SALTS) -> DataFrame:
    """Aggregates per value of each key column without a task that holds a hot key alone; two scans whatever the number of columns.

    ``partials`` are the aggregates of raw rows, ``merges`` says by which function (sum, min, max) two partial values combine.
    The first scan finds the heavy values (``heavy_hitters``). In the second a broadcast join with their list marks the rows of heavy
    keys, which go to the shuffle under a salt, those of the other keys as they are, all combined before it. The partial values of
    heavy keys are merged in a second step and united with the rest; both read the same shuffle.

    Result: ``key_column``, ``key_value`` (as text), ``is_heavy``, the aggregates. Defined cases: the null key is one group among the
    light ones; an empty table gives no rows; ties and repeated rows are counted as rows; further columns are ignored.
    """
    heavy, _ = heavy_hitters(df, keys, share)
    rows = df
    for i, key in enumerate(keys):
        rows = rows.join(F.broadcast(_listed(df, key, heavy[key], f"__qs_h{i}")), F.col(f"`{key}`") == F.col(f"__qs_h{i}"), "left")
    ids, salted = [f"__qs_k{i}" for i in range(len(keys))], [f"__qs_s{i}" for i in range(len(keys))]
    rows = rows.select("*", *[F.col(f"`{key}`").alias(n) for key, n in zip(keys, ids)], *[F.when(F.col(f"__qs_h{i}").isNotNull(), F.pmod(F.spark_partition_id(), F.lit(salts))).alias(n) for i, n in enumerate(salted)])
    names = list(partials)
    sets = [[F.col(k), F.col(s)] for k, s in zip(ids, salted)]
    # Which set a row belongs to: the only key that was not set aside.
    column = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(key)) for k, key in zip(ids, keys)])
    value = F.coalesce(*[F.col(k).cast("string") for k in ids])
    is_heavy = F.max(F.coalesce(*[F.when(F.col(s).isNotNull(), True) for s in salted], F.lit(False)))
    part = rows.groupingSets(sets, *ids, *salted).agg(column.alias("key_column"), value.alias("key_value"), is_heavy.alias("is_heavy"), *[partials[n].alias(n) for n in names])
    part = part.select("key_column", "key_value", "is_heavy", *names)
    hot = part.where("is_heavy").groupBy("key_column", "key_value", "is_heavy").agg(*[getattr(F, merges[n])(n).alias(n) for n in names])
    return hot.unionByName(part.where("NOT is_heavy"))


def per_key(df: DataFrame, key: str, partials: dict[str, Column], merges: dict[str, str], share: float = 0.01, salts: int = SALTS) -> DataFrame:
    """``per_keys`` of one column, with its values in their own type."""
    out = per_keys(df, [key], partials, merges, share, salts)
    return out.select(F.col("key_value").cast(df.schema[key].dataType).alias(key), "is_heavy", *partials)


def heavy_counts(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """``key_column``, ``key_value``, ``rows`` of the values that hold at least ``share`` of all rows, exact: candidates from the
    sketches, counted by broadcast join in one more scan."""
    heavy, total = heavy_hitters(df, keys, share)
    least = Fraction(str(share))  # compared in whole numbers
    rows = df.select(*[F.col(f"`{key}`").alias(f"__qs_k{i}") for i, key in enumerate(keys)])
    for i, key in enumerate(keys):
        rows = rows.join(F.broadcast(_listed(df, key, heavy[key], f"__qs_h{i}")), F.col(f"__qs_k{i}") == F.col(f"__qs_h{i}"), "left")
    ids = [f"__qs_h{i}" for i in range(len(keys))]
    column = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(key)) for k, key in zip(ids, keys)])
    counted = rows.select(*ids).groupingSets([[F.col(k)] for k in ids], *ids).agg(column.alias("key_column"), F.coalesce(*[F.col(k).cast("string") for k in ids]).alias("key_value"), F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("key_value").isNotNull() & (F.col("rows") * least.denominator >= least.numerator * total)).select("key_column", "key_value", "rows")


def skew_join(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, share: float = 0.01) -> DataFrame:
    """Left join of a skewed fact with a dimension unique by ``dim_key``: heavy keys by broadcast join, the rest by ordinary shuffle.

    Only the heavy keys' rows of ``dim`` are broadcast, at most 2 / share. Columns of ``dim`` must not clash with those of
    ``fact``; ``dim_key`` is dropped. Rows with a null key stay, unmatched.
    """
    heavy = heavy_hitters(fact, [key], share)[0][key]
    hot, rest = split_by_weight(fact, key, heavy)
    few, _ = split_by_weight(dim, dim_key, heavy)
    on = F.col(f"`{key}`") == F.col(f"`{dim_key}`")
    return hot.join(F.broadcast(few), on, "left").unionByName(rest.join(dim, on, "left")).drop(dim_key)
