"""Column-level quality profile kept as persistent value-count tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.session import cut, read_text, write_text

STATE = "table_name string, column_name string, value string, value_num double, n long"
KEYS = ["table_name", "column_name", "value", "value_num"]


def as_value(df: DataFrame, name: str) -> tuple[Column, Column]:
    """A column as text, which is what is counted, and as number if it is one."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(col.isNotNull(), F.to_json(F.struct(col.alias("v")))), F.lit(None).cast("double")
    if isinstance(kind, T.BinaryType):
        return F.hex(col), F.lit(None).cast("double")
    return col.cast("string"), col.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def value_counts(df: DataFrame, table: str, columns: Sequence[str] | None = None, by: Column | None = None, sign: int = 1) -> DataFrame:
    """The value-count table of each column: how often each value occurs, null among them, times ``sign``.

    Each column is grouped in its own type with a combine before the shuffle, and only its distinct values are turned to strings;
    no row is exploded over the columns. ``by`` adds a ``load``. A value that holds a third of all rows is one row per task.
    """
    parts = []
    for c in df.columns if columns is None else columns:
        text, number = as_value(df, c)
        kind = df.schema[c].dataType
        groupable = F.col(f"`{c}`") if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType) else text
        load = [] if by is None else [by.alias("load")]
        grouped = df.select(*load, groupable.alias("__qs_v")).groupBy(*(["load"] if load else []), "__qs_v").agg((F.count(F.lit(1)) * sign).alias("n"))
        text, number = as_value(grouped, "__qs_v")
        parts.append(grouped.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), *(["load"] if load else []), text.alias("value"), number.alias("value_num"), "n"))
    return reduce(DataFrame.unionByName, parts)


def apply_delta(state: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The state after signed deltas; values whose count returns to zero leave it."""
    every = reduce(DataFrame.unionByName, [x.select(*KEYS, "n") for x in (state, *deltas)])
    return every.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


@dataclass(frozen=True)
class Rule:
    """``broken`` on the columns value, value_num and n says which values of a column break its form. A rule that needs other columns
    of the row is stated on ``counted``, a struct of them that is counted beside the column."""

    table: str
    column: str
    broken: Column
    counted: str | None = None

    def on_state(self) -> Column:
        """Whether a row of the state is a value that breaks the rule."""
        return (F.col("table_name") == self.table) & (F.col("column_name") == (self.counted or self.column)) & F.col("value").isNotNull() & F.coalesce(self.broken, F.lit(False))


def metrics(state: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Per column: rows, nulls, null rate, distinct values, range, entropy in nats, the most frequent value, violations.

    Entropy comes from the counts alone: ln N - sum(n ln n) / N over the values that are not null. Numbers are ranged as numbers,
    everything else as text (dates in ISO form). A column of nulls has no range, 0 distinct values and null entropy. ``violations``
    counts the rows whose value breaks the rule of its column; it is null where there is none. Counted structs have no row of their own.
    """
    v, n = F.col("value"), F.col("n")
    present = F.when(v.isNotNull(), n)
    numeric = F.max("value_num").isNotNull()
    total = F.sum(present)
    broken = F.coalesce(*[F.when(r.on_state(), n) for r in rules]) if rules else F.lit(None).cast("long")
    out = state.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"),
        (F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)) / F.sum("n")).alias("null_rate"),
        F.count(v).alias("distinct_values"),
        F.when(numeric, F.min_by("value", "value_num")).otherwise(F.min("value")).alias("min_value"),
        F.when(numeric, F.max_by("value", "value_num")).otherwise(F.max("value")).alias("max_value"),
        (F.ln(total) - F.sum(present * F.ln(present)) / total).alias("entropy"),
        F.max(present).alias("top_count"),
        F.coalesce(F.sum(broken), F.lit(0)).alias("__qs_broken"),
    )
    own = F.coalesce(*[F.when((F.col("table_name") == r.table) & (F.col("column_name") == r.column), True) for r in rules], F.lit(False)) if rules else F.lit(False)
    beside = [r for r in rules if r.counted]
    if not beside:
        return out.withColumn("violations", F.when(own, F.col("__qs_broken"))).drop("__qs_broken")
    # One row per column of every table: the counts of a struct go to the column that its rule is about.
    ruled = F.coalesce(*[F.when((F.col("table_name") == r.table) & (F.col("column_name") == r.counted), F.lit(r.column)) for r in beside])
    moved = out.where(ruled.isNotNull()).select(F.col("table_name").alias("__qs_t"), ruled.alias("__qs_c"), F.col("__qs_broken").alias("__qs_moved"))
    both = out.where(ruled.isNull()).join(moved, (F.col("table_name") == F.col("__qs_t")) & (F.col("column_name") == F.col("__qs_c")), "left")
    return both.withColumn("violations", F.when(own, F.coalesce("__qs_moved", "__qs_broken"))).drop("__qs_broken", "__qs_t", "__qs_c", "__qs_moved")


def load_shift(by_load: DataFrame) -> DataFrame:
    """How far each column's distribution moved between consecutive loads: total variation distance and null rates.

    Counts of a load are tagged as the later side of their load and the earlier side of the next, and one aggregation by value
    meets the two; per-load totals are joined from a table of one row per column and load. The first load of a table has no shift.
    """
    by_load = cut(by_load)  # read three times below
    loads = by_load.select("table_name", "load").distinct()
    following = loads.withColumn("next_load", F.lead("load").over(Window.partitionBy("table_name").orderBy("load")))
    totals = by_load.groupBy("table_name", "column_name", "load").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    shares = by_load.join(totals.drop("nulls"), ["table_name", "column_name", "load"]).join(following, ["table_name", "load"])
    shares = shares.withColumn("share", F.col("n") / F.col("total"))
    sides = F.array(F.struct(F.col("load").alias("at"), F.col("share").alias("s")), F.struct(F.col("next_load").alias("at"), (-F.col("share")).alias("s")))
    tagged = shares.select("table_name", "column_name", "value", F.explode(sides).alias("x")).where(F.col("x.at").isNotNull())
    moved = tagged.groupBy("table_name", "column_name", F.col("x.at").alias("load"), "value").agg(F.sum("x.s").alias("d"))
    tv = moved.groupBy("table_name", "column_name", "load").agg((F.sum(F.abs("d")) / 2).alias("shift"))
    first = loads.groupBy("table_name").agg(F.min("load").alias("first_load"))
    out = totals.join(tv, ["table_name", "column_name", "load"], "left").join(first, "table_name")
    return out.select(
        "table_name", "column_name", "load", F.col("total").alias("rows"), (F.col("nulls") / F.col("total")).alias("null_rate"), F.when(F.col("load") > F.col("first_load"), F.col("shift")).alias("shift")
    )


class ValueCountStore:
    """Value-count tables kept under a shared path, in parts by column and bucket of values; a load rewrites the parts that it touches.

    A manifest of each version says which load it applied and in which folder each part stands. It is written under another name and
    renamed, so a lost executor or driver leaves the last version intact. A load that was applied before is not applied again.
    ``buckets`` is fixed when the store is made; it bounds what a change of one value rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 2):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"version": 0, "loads": [], "buckets": self.buckets, "parts": {}}
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{names[-1]}"))

    def versions(self) -> list[tuple[int, str]]:
        """(number, load) of the versions, in order."""
        return [(i + 1, load) for i, load in enumerate(self._manifest()["loads"])]

    @staticmethod
    def _prefix(table: Column, column: Column) -> Column:
        return F.left(F.md5(F.concat_ws("\0", table, column)), F.lit(16))

    def state(self, columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
        """The latest state, of all columns or of some (table, column): only their parts are read. Empty before the first load."""
        parts = self._manifest()["parts"]
        if columns is not None:
            wanted = {hashlib.md5(f"{t}\0{c}".encode()).hexdigest()[:16] for t, c in columns}
            parts = {p: v for p, v in parts.items() if p.split("-")[0] in wanted}
        return self._read(parts)

    def _read(self, parts: dict[str, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.path}/data/v={v:08d}/part={p}" for p, v in sorted(parts.items())])

    def apply(self, load: str, *deltas: DataFrame) -> DataFrame:
        """Apply a load's signed deltas once and return the new state."""
        now = self._manifest()
        if load in now["loads"]:
            return self.state()
        at = now["version"] + 1
        bucket = F.pmod(F.xxhash64(F.coalesce("value", F.lit(""))), F.lit(now["buckets"])).cast("string")
        part = F.concat(self._prefix(F.col("table_name"), F.col("column_name")), F.lit("-"), bucket)
        delta = cut(apply_delta(*deltas).withColumn("part", part))
        # Parts are columns times buckets, whatever the number of values.
        touched = {r.part for r in delta.select("part").distinct().collect()}
        old = self._read({p: v for p, v in now["parts"].items() if p in touched})
        merged = apply_delta(old, delta).withColumn("part", part)
        folder = f"{self.path}/data/v={at:08d}"
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
        left = {s.getPath().getName()[5:] for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()}
        parts = {p: v for p, v in now["parts"].items() if p not in touched} | {p: at for p in left}
        write_text(self.spark, f"{self.path}/manifest/{at:08d}.json", json.dumps({"version": at, "loads": [*now["loads"], load], "buckets": now["buckets"], "parts": parts}))
        return self.state()
