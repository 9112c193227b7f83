"""Row hashes and Bloom filters, evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.internal import InternalFunction

#: A filter never takes more bits than this (8 MB), whatever the number of keys; beyond, only its hit rate worsens.
MAX_BLOOM_BITS = 67_108_864


def _plain(df: DataFrame, name: str) -> Column:
    """The column in a form that can be hashed; maps and variants go through JSON."""
    kind = df.schema[name].dataType
    return F.to_json(F.struct(F.col(f"`{name}`"))) if isinstance(kind, (T.MapType, T.VariantType)) else F.col(f"`{name}`")


def row_hash(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of the columns as stored.

    Spark's hash skips nulls, so each value is followed by its null flag: (null, 'a') and ('a', null) differ.
    """
    parts = [x for c in columns for x in (_plain(df, c), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x51AE), *parts)]


def bloom_bits(items: int, fpp: float) -> int:
    """Bits for ``items`` keys at the wanted rate of false positives, within MAX_BLOOM_BITS."""
    return int(min(MAX_BLOOM_BITS, max(64, math.ceil(-max(1, items) * math.log(fpp) / math.log(2) ** 2))))


def build_blooms(keyed: Sequence[tuple[DataFrame, Column, int]], fpp: float = 0.01) -> list[bytes | None]:
    """Bloom filters of at most 8 MB each over (frame, key, number of keys), in one job; None over no rows."""
    parts = []
    for i, (df, key, items) in enumerate(keyed):
        agg = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.xxhash64(key), F.lit(max(1, items)).cast("bigint"), F.lit(bloom_bits(items, fpp)).cast("bigint"))
        parts.append(df.agg(agg.alias("bloom")).select(F.lit(i).alias("i"), "bloom"))
    rows = {r.i: r.bloom for r in reduce(DataFrame.unionByName, parts).collect()}
    return [None if rows.get(i) is None else bytes(rows[i]) for i in range(len(keyed))]


def build_bloom(df: DataFrame, key: Column, items: int, fpp: float = 0.01) -> bytes | None:
    """One distributed aggregation to a Bloom filter of at most 8 MB; None over no rows."""
    return build_blooms([(df, key, items)], fpp)[0]


def might_contain(bloom: bytes | None, key: Column) -> Column:
    """Whether the filter may hold the key: false is certain. Runs in whole-stage codegen."""
    if bloom is None:
        return F.lit(False)
    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    return F.coalesce(ClassicColumn(utils.column(test(utils.expression(F.lit(bloom)._jc), utils.expression(F.xxhash64(key)._jc)))), F.lit(False))
