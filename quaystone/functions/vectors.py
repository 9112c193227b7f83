"""Exact vector search."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for a vector of zeros or a null one."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, row_id: Sequence[str], exclude: Column | None = None, floor: float = 0.0) -> DataFrame:
    """The ``k`` rows nearest by cosine, ties by id: one scan and a top-k per task, no sort of the table.

    Null vectors are left out and ``exclude`` applies before the limit. ``floor`` marks, after the ranking, what a threshold would
    keep; at 0 or below it keeps all.
    """
    rows = df.where(F.col(vector).isNotNull())
    if exclude is not None:
        rows = rows.where(~exclude)
    q = query_vector(query)
    ranked = rows.withColumn("similarity", cosine(F.col(vector), q)).where(F.col("similarity").isNotNull())
    top = ranked.orderBy(F.desc("similarity"), *row_id).limit(k)
    return top.withColumn("kept", (F.lit(floor) <= 0) | (F.col("similarity") >= floor))


#: Vectors of a block of each side of ``nearest_set``, on average.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Rows multiplied at once within a block, so that the products stay in cache.
_STRIP = 256


def nearest_set(rows: DataFrame, queries: DataFrame, vector: str, k: int, row_id: str, exclude: Column | None = None, floor: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """query_id, ``row_id``, ``keep``, similarity, kept: what ``nearest`` gives, for every vector of ``queries`` instead of one.

    Both sides are dealt out by id to blocks of bounded size, and every block of queries meets every block of rows of its width in a
    task that returns at most ``k`` rows per query; the tops of a query's blocks are ranked once more. Neither side is broadcast or
    gathered, and the work is one product per pair. Products add up in the order of ``dot``, so similarities and ties are those of
    ``nearest``. Vectors that are null, hold a null or NaN, or are of length 0 have no similarity.
    """
    if exclude is not None:
        rows = rows.where(~exclude)
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    sides = [
        rows.where(whole).select(F.col(row_id), *keep, F.col(vector).alias("__qs_v"), F.size(vector).alias("__qs_w")),
        queries.where(whole).select(F.col(row_id).alias("query_id"), F.col(vector).alias("__qs_v"), F.size(vector).alias("__qs_w")),
    ]
    nr, nq = (max(1, math.ceil(x.count() / most)) for x, most in zip(sides, (ROW_BLOCK, QUERY_BLOCK), strict=True))

    def dealt(side, by, own, n, other, m):
        block = F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias(own)
        return side.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    at = ["__qs_w", "__qs_q", "__qs_r"]
    r, q = dealt(sides[0], row_id, "__qs_r", nr, "__qs_q", nq), dealt(sides[1], "query_id", "__qs_q", nq, "__qs_r", nr)
    carried = [row_id, *keep]
    out = T.StructType([T.StructField("query_id", queries.schema[row_id].dataType), *[rows.schema[c] for c in carried], T.StructField("similarity", T.DoubleType())])
    pairs = q.groupBy(*at).cogroup(r.groupBy(*at)).applyInPandas(_block_tops(carried, k), out)
    first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    top = pairs.withColumn("__qs_n", F.row_number().over(first)).where(F.col("__qs_n") <= k).drop("__qs_n")
    return top.withColumn("kept", (F.lit(floor) <= 0) | (F.col("similarity") >= floor))


def _block_tops(carried: Sequence[str], k: int):
    def tops(q, r):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(r):
            return pd.DataFrame({c: [] for c in ("query_id", *carried, "similarity")})
        r = r.sort_values(carried[0], kind="stable").reset_index(drop=True)
        a, b = (np.stack(x["__qs_v"].to_numpy()).astype("float64") for x in (q, r))

        def length(m):
            total = np.zeros(len(m))
            for i in range(m.shape[1]):
                total += m[:, i] * m[:, i]
            return np.sqrt(total)

        la, lb = length(a), length(b)
        best_s, best_i = np.empty((len(a), 0)), np.empty((len(a), 0), dtype="int64")
        for begin in range(0, len(b), _STRIP):
            strip = b[begin : begin + _STRIP]
            s = np.zeros((len(a), len(strip)))
            for i in range(a.shape[1]):
                s += strip[:, i] * a[:, i, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                s /= lb[begin : begin + _STRIP] * la[:, None]
            s[~np.isfinite(s)] = -np.inf
            # Earlier rows have lower ids and a stable sort keeps them first, so ties go by id.
            s, i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(np.arange(begin, begin + len(strip)), s.shape)])
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        found = np.isfinite(best_s)
        hit = r.loc[best_i[found], list(carried)].reset_index(drop=True)
        hit.insert(0, "query_id", np.repeat(q["query_id"].to_numpy(), found.sum(axis=1)))
        hit["similarity"] = best_s[found]
        return hit

    return tops


def widths(df: DataFrame, vector: str, expected: int) -> DataFrame:
    """width, rows, fits: every width of stored vectors against the expected one."""
    return df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("rows")).withColumn("fits", F.col("width") == expected)


def pending(df: DataFrame, vector: str, model: str, wanted: str) -> DataFrame:
    """Rows that still need an embedding: none stored, or one of another model."""
    return df.where(F.col(vector).isNull() | ~F.col(model).eqNullSafe(F.lit(wanted)))


class SeededEmbedder:
    """A deterministic stand-in for an embedding model: a unit vector from a generator seeded by the SHA-256 of model name and text."""

    def __init__(self, dimensions: int = 768, model: str = "fake-embedding"):
        if dimensions < 1:
            raise ValueError("a vector has at least one dimension")
        self.dimensions, self.model = dimensions, model

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            rng = random.Random(int.from_bytes(hashlib.sha256(f"{self.model}:{text}".encode()).digest(), "big"))
            v = [rng.gauss(0, 1) for _ in range(self.dimensions)]
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out
