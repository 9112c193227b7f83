"""Typed scans of Parquet exports, single files or Hive-partitioned by day."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.schema import Table


class ScanError(ValueError):
    """An export that does not hold what it must."""


@dataclass(frozen=True)
class Scope:
    """Half-open range of days; an open end is None."""

    start: date | None = None
    end: date | None = None

    def __post_init__(self):
        if self.start and self.end and self.start >= self.end:
            raise ScanError(f"empty range: {self.start} to {self.end}")

    def column(self, key: str = "date_key") -> Column:
        """The predicate on the bare key column, so that it reaches the scan as partition or row-group filter."""
        ends = [F.col(key) >= F.lit(self.start)] * bool(self.start) + [F.col(key) < F.lit(self.end)] * bool(self.end)
        return reduce(lambda a, b: a & b, ends, F.lit(True))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet file itself, or the sorted Parquet files of a folder; an error if there are none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise ScanError(f"not found: {path}")
    if fs.getFileStatus(p).isFile():
        return [path]
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))
    if not found:
        raise ScanError(f"no Parquet files in {path}")
    return found


def is_partitioned(spark: SparkSession, path: str, key: str = "date_key") -> bool:
    """Whether the folder is laid out as key=value folders."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory() and any(s.isDirectory() and s.getPath().getName().startswith(f"{key}=") for s in fs.listStatus(p))


def check_columns(found: Sequence[str], wanted: Sequence[str], where: str, optional: Sequence[str] = ()) -> None:
    """The exact set of columns, or an error that names what is missing and what is unexpected."""
    missing, extra = sorted(set(wanted) - set(found) - set(optional)), sorted(set(found) - set(wanted))
    if missing or extra:
        raise ScanError(f"{where}: missing columns {missing}, unexpected columns {extra}")


def read_table(spark: SparkSession, path: str, table: Table, scope: Scope = Scope(), columns: Sequence[str] | None = None, optional: Sequence[str] = (), tolerate: Sequence[str] = ()) -> DataFrame:
    """A declared table: column set checked against the files, then read with the declared types, filtered and projected in the scan.

    The partition key is typed by the declaration, not inferred from folder names.
    """
    present = [c for c in spark.read.parquet(path).columns if c not in tolerate]
    check_columns(present, list(table.columns), path, optional)
    struct = T.StructType([f for f in table.struct if f.name in present])
    df = spark.read.schema(struct).parquet(path)
    if table.partitioned_by:
        df = df.where(scope.column(table.partitioned_by))
    return df.select(*(columns or [c for c in table.columns if c in present]))


def violations(df: DataFrame, table: Table) -> DataFrame:
    """table_name, rule, rows_failed: all rules of the table in one aggregation."""
    checks = table.broken()
    one = df.agg(*[F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias(name) for name, bad in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("rows_failed")) for n in checks]))
    return one.select(pairs.alias("r")).select(F.lit(table.name).alias("table_name"), "r.rule", "r.rows_failed")


def offenders(df: DataFrame, table: Table) -> DataFrame:
    """The rows that break a rule, with the file they stand in and the names of the rules."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in table.broken().items()]), lambda x: x.isNotNull())
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


@dataclass(frozen=True)
class Manifest:
    """What an export claims to hold."""

    exported_at: datetime
    first: date
    last: date
    total_rows: int
    rows_per_year: dict[str, int]
    dimensions: dict[str, int]


def read_manifest(text: str) -> Manifest:
    """Parse and check a manifest: version 2, a span in order, years that add up."""
    try:
        raw = json.loads(text)
        fact = raw["fact_stop_event"]
        version = raw["contract_version"]
        out = Manifest(
            datetime.fromisoformat(raw["exported_at"].replace("Z", "+00:00")),
            date.fromisoformat(fact["min_date_key"]),
            date.fromisoformat(fact["max_date_key"]),
            int(fact["total_rows"]),
            {str(k): int(v) for k, v in fact["rows_per_year"].items()},
            {str(k): int(v) for k, v in raw["dimensions"].items()},
        )
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ScanError(f"manifest: {e!r}") from e
    if version != 2:
        raise ScanError(f"manifest: version {version}, not 2")
    if out.first > out.last:
        raise ScanError("manifest: the span is inverted")
    if sum(out.rows_per_year.values()) != out.total_rows:
        raise ScanError("manifest: the years do not add up to the total")
    return out


def dimension_gate(manifest: Manifest, name: str, rows: int) -> list[str]:
    """What keeps a dimension from being published: a count that the manifest does not declare, or declares otherwise."""
    if name not in manifest.dimensions:
        return [f"{name}: {rows} rows that the manifest does not declare"]
    return [] if manifest.dimensions[name] == rows else [f"{name}: {rows} rows, the manifest has {manifest.dimensions[name]}"]


def coverage_gate(manifest: Manifest, loaded: int, on_disk: int, scope: Scope = Scope()) -> list[str]:
    """What keeps a load from being published; empty if nothing does. Run before publishing."""
    if scope == Scope():
        return [] if loaded == manifest.total_rows else [f"{loaded} rows loaded, the manifest has {manifest.total_rows}"]
    out = []
    if (scope.start and scope.start < manifest.first) or (scope.end and (scope.end - manifest.last).days > 1):
        out.append("the range lies outside the export's coverage")
    if loaded != on_disk:
        out.append(f"{loaded} rows loaded, {on_disk} on disk in range")
    return out


BLOCKS = T.StructType(
    [
        T.StructField("kind", TEXT := T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("section", TEXT),
        T.StructField("text", TEXT),
        T.StructField("level", T.IntegerType()),
        T.StructField("cells", T.MapType(TEXT, TEXT)),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("_corrupt", TEXT),
    ]
)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A document's block stream, one JSON object a line: parsed blocks plus ``error`` for lines that are none, with file and line text."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    parsed = lines.withColumn("b", F.from_json("value", BLOCKS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    need = F.when(F.col("b.kind") == "table_row", F.col("b.cells").isNotNull()).when(F.col("b.kind").isin("heading", "paragraph"), F.col("b.text").isNotNull()).otherwise(F.lit(False))
    return parsed.select("file", "b.*", F.when(F.col("b._corrupt").isNotNull() | ~F.coalesce(need, F.lit(False)), F.col("value")).alias("error")).drop("_corrupt")


def write_blocks(df: DataFrame, path: str) -> None:
    df.drop("error", "file").write.mode("overwrite").json(path, ignoreNullFields=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), text of every Markdown file of a folder."""
    return spark.read.text(f"{path}/*.md", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), F.col("value").alias("text"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of each file under a path, to verify pinned sources."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by the given columns; no window: one aggregation with a combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("__qs_last")).select(*key, *[F.col(f"__qs_last.{c}").alias(c) for c in rest])
