"""Rollup rows kept up to date from a stream of fact files, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaystone.operators.rollups import MEASURES, rollup
from quaystone.schema import FACT


def fact_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New fact files of a folder, with the declared types."""
    return spark.readStream.schema(FACT.struct).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_partials(stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's partial daily sums under ``out``, one folder per batch number.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice; a late row is one more partial, so
    no watermark drops it. ``current`` adds the partials up.
    """

    def write(batch: DataFrame, number: int) -> None:
        rollup(batch, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rollup as of the batches written so far."""
    return spark.read.parquet(out).groupBy("date_key", key).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
