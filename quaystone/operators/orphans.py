"""References to records that do not exist, or did not exist yet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.hashing import build_blooms, might_contain
from quaystone.session import BROADCAST_BYTES, cut, measured_join, sizes_of


@dataclass(frozen=True)
class Reference:
    """``column`` of the child names ``parent_key`` of ``parent``, which became available at ``parent_since``."""

    column: str
    parent: DataFrame
    parent_key: str
    parent_since: str | None = None


def orphan_references(child: DataFrame, row_id: Sequence[str], refs: Sequence[Reference], landed: str | None = None, fpp: float = 0.01, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per child row and referring column whose key the parent lacks (``missing``) or got only later (``late``).

    A Bloom filter of the parent keys (at most 8 MB) travels with the plan: keys it denies are orphans for certain and are not
    joined. Keys it admits are verified by an exact join. Parents whose measured bytes are within ``broadcast_bytes`` are
    broadcast, so that all columns are checked in one pass without a shuffle. Larger parents meet the distinct admitted keys only
    (combined before the shuffle, so a hot key is one row); the keys found wanting are joined back, salted if they are many.

    Result: the row ids, ``ref_column``, ``ref_value`` string, ``ref_status``. Defined cases: a null reference is no case; a key
    held by several parent rows counts from the earliest; a null ``parent_since`` counts as always there; a null ``landed`` is
    never late; repeated child rows come out repeatedly; an empty parent makes every reference missing; an empty child gives no
    rows. Keys of different types are compared as strings.
    """
    ids = [F.col(f"`{c}`").alias(f"__qs_id{i}") for i, c in enumerate(row_id)]
    when = F.col(f"`{landed}`") if landed else F.lit(None).cast("timestamp")
    kinds = [(dict(child.dtypes)[r.column], dict(r.parent.dtypes)[r.parent_key]) for r in refs]
    base = child.select(*ids, when.alias("__qs_landed"), *[(F.col(f"`{r.column}`") if a == b else F.col(f"`{r.column}`").cast("string")).alias(f"__qs_c{i}") for i, (r, (a, b)) in enumerate(zip(refs, kinds))])
    keyed = []
    for i, (r, (a, b)) in enumerate(zip(refs, kinds)):
        key = F.col(f"`{r.parent_key}`") if a == b else F.col(f"`{r.parent_key}`").cast("string")
        since = F.col(f"`{r.parent_since}`") if r.parent_since else F.lit(None).cast("timestamp")
        # A parent row without a date was always there.
        one = r.parent.where(key.isNotNull()).groupBy(key.alias(f"__qs_p{i}")).agg(F.when(F.count(since) == F.count(F.lit(1)), F.min(since)).alias(f"__qs_s{i}"))
        keyed.append(one)
    # Two jobs for all parents: their sizes, their filters.
    sizes = sizes_of(*keyed)
    keyed = [one if size.bytes <= broadcast_bytes else cut(one) for one, size in zip(keyed, sizes)]  # a large one is read again by the filter and the join
    blooms = build_blooms([(one, F.col(f"__qs_p{i}"), size.rows) for i, (one, size) in enumerate(zip(keyed, sizes))], fpp)
    parents = list(zip(keyed, sizes, blooms))

    id_names = [f"__qs_id{i}" for i in range(len(row_id))]
    out = None
    small = [i for i, size in enumerate(sizes) if size.bytes <= broadcast_bytes]
    if small:
        wide, found = base, []
        for i in small:
            one, _, bloom = parents[i]
            maybe = might_contain(bloom, F.col(f"__qs_c{i}"))
            wide = wide.withColumn(f"__qs_m{i}", F.when(maybe, F.col(f"__qs_c{i}")))
            wide = wide.join(F.broadcast(one), F.col(f"__qs_m{i}") == F.col(f"__qs_p{i}"), "left")
            status = F.when(F.col(f"__qs_c{i}").isNotNull(), F.when(F.col(f"__qs_p{i}").isNull(), F.lit("missing")).when(F.col(f"__qs_s{i}") > F.col("__qs_landed"), F.lit("late")))
            found.append(F.when(status.isNotNull(), F.struct(F.lit(refs[i].column).alias("column"), F.col(f"__qs_c{i}").cast("string").alias("value"), status.alias("status"))))
        out = wide.select(*id_names, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("__qs_case"))
        out = out.select(*id_names, F.col("__qs_case.column").alias("ref_column"), F.col("__qs_case.value").alias("ref_value"), F.col("__qs_case.status").alias("ref_status"))
    for i in (i for i in range(len(refs)) if i not in small):
        one, _, bloom = parents[i]
        key, maybe = F.col(f"__qs_c{i}"), might_contain(bloom, F.col(f"__qs_c{i}"))
        mine = base.select(*id_names, "__qs_landed", key).where(key.isNotNull())
        certain = mine.where(~maybe).select(*id_names, F.lit(refs[i].column).alias("ref_column"), key.cast("string").alias("ref_value"), F.lit("missing").alias("ref_status"))
        admitted = mine.where(maybe)
        keys = admitted.groupBy(key.alias("__qs_k")).agg(F.min("__qs_landed").alias("__qs_first"))
        wanting = keys.join(one, F.col("__qs_k") == F.col(f"__qs_p{i}"), "left").where(F.col(f"__qs_p{i}").isNull() | (F.col(f"__qs_s{i}") > F.col("__qs_first")))
        wanting = wanting.select("__qs_k", F.col(f"__qs_p{i}").isNull().alias("__qs_gone"), F.col(f"__qs_s{i}").alias("__qs_since"))
        back = measured_join(admitted, wanting, f"__qs_c{i}", "__qs_k", "inner", sizes_of(wanting)[0], F.struct(*id_names, "__qs_landed"), broadcast_bytes)
        verified = back.where(F.col("__qs_gone") | (F.col("__qs_since") > F.col("__qs_landed"))).select(
            *id_names, F.lit(refs[i].column).alias("ref_column"), key.cast("string").alias("ref_value"), F.when(F.col("__qs_gone"), F.lit("missing")).otherwise(F.lit("late")).alias("ref_status")
        )
        part = certain.unionByName(verified)
        out = part if out is None else out.unionByName(part)
    return out.select(*[F.col(n).alias(c) for n, c in zip(id_names, row_id)], "ref_column", "ref_value", "ref_status")


def orphan_counts(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cases per reference, status and the given columns (a load, a day), combined before the shuffle."""
    return cases.groupBy(*by, "ref_column", "ref_status").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_value").alias("orphan_keys"))
