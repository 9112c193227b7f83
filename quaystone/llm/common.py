"""Shared helpers of the text operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quaystone.session import ship_package


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over the cluster's cores if it has fewer partitions than that; else leave them where they are.

    Only for scans and other plans without a shuffle: counting partitions plans the frame.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def rank_error(k: int) -> float:
    """Normalised rank error of a compactor hierarchy of size ``k`` at 99 % confidence (published fit for this kind of sketch)."""
    return 2.296 / math.pow(k, 0.9723)


def map_texts(df: DataFrame, key: str, text: str, name: str, over: Callable[[list, list], Iterator[dict[str, list]]], schema: dict[str, str]) -> DataFrame:
    """Texts through Python in Arrow batches, which Spark bounds by bytes: ``over(keys, texts)`` yields columns named by ``schema``.

    The key column comes out as ``name`` in its own type, so null keys and 64-bit keys stay exact. No shuffle.
    """
    ship_package(df.sparkSession)
    kinds = {c: to_arrow_type(T._parse_datatype_string(k)) for c, k in schema.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = {name: batch.schema.field(0).type} | kinds
            for out in over(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(out[c], type=t) for c, t in types.items()], names=list(types))

    rows = spread(df.select(F.col(f"`{key}`").alias(name), F.col(f"`{text}`").alias("__qs_text")))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in {f"`{name}`": kind, **schema}.items()))
