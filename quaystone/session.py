"""Session helpers: reading the tables, cutting lineage in shared storage, joins whose broadcast side is measured."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured side of a join is broadcast.
BROADCAST_BYTES = 64_000_000
#: Copies of the small side in a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; a local folder only in local mode, where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quaystone-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; the driver serves the archive, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_quaystone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quaystone-ship-")  # the driver serves it as long as the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "quaystone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._quaystone_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row takes in a broadcast relation, at least: 16 for the row, 8 a column, and the length of what is longer."""
    long = [f for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    texts = [F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in long]
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(t), F.lit(0)) for t in texts], F.lit(16 + 8 * len(df.columns)))


@dataclass(frozen=True)
class Size:
    """Rows and bytes, as measured."""

    rows: int
    bytes: int


def sizes_of(*frames: DataFrame) -> list[Size]:
    """The sizes of frames, measured in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0)).alias("b")).select(F.lit(i).alias("i"), "n", "b") for i, df in enumerate(frames)]
    return [Size(r.n, r.b) for r in sorted(reduce(DataFrame.unionByName, parts).collect())]


def measured_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    right_size: Size,
    spread: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join on one key where ``right`` is unique by ``right_key`` and its size was measured.

    Within ``broadcast_bytes`` the right side is broadcast. Beyond, both sides are shuffled with a salt taken from ``spread``
    (any well-spread expression of the left row), so that one hot key is dealt out to ``salts`` tasks.
    """
    if right_size.bytes <= broadcast_bytes:
        return left.join(F.broadcast(right), F.col(left_key) == F.col(right_key), how)
    salted = left.withColumn("__qs_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__qs_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = (F.col(left_key) == F.col(right_key)) & (F.col("__qs_salt") == F.col("__qs_copy"))
    return salted.join(copies, on, how).drop("__qs_salt", "__qs_copy")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file from any file system that Spark reads; None if there is none."""
    held = read_bytes(spark, path)
    return None if held is None else held.decode("utf-8")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, see ``write_bytes``."""
    write_bytes(spark, path, text.encode("utf-8"))


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file that fits the driver, from any file system that Spark reads; None if there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Written beside its place and renamed, so that readers see the old file or the new one."""
    fs, p = _hadoop(spark, path)
    fresh = _hadoop(spark, path + ".new")[1]
    stream = fs.create(fresh, True)
    try:
        stream.write(content)
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(fresh, p):
        raise OSError(f"cannot write {path}")
