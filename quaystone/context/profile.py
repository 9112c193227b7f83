"""The measured extent of the facts and samples of known values, kept in a snapshot."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quaystone.operators import rollups
from quaystone.operators.runlog import ProfileSnapshot

SAMPLE = 12


def measure(spark: SparkSession, schema: str = "gold", sample: int = SAMPLE) -> dict:
    """Exact counts and coverage of the fact, the calendar's span, the most active stations, operators and relations."""
    out = {k: str(v) if k.endswith("_day") and v is not None else v for k, v in rollups.coverage_profile(spark.table(f"{schema}.fact_stop_event")).first().asDict().items()}
    calendar = spark.table(f"{schema}.dim_date").agg(F.min("date_key"), F.max("date_key")).first()
    stations = spark.table(f"{schema}.dim_station").where("station_key <> -1 AND station_name IS NOT NULL").orderBy(F.desc_nulls_last("observed_stop_events"), "station_key").limit(sample)
    relation = spark.table(f"{schema}.dim_relation")
    out |= {"calendar": [str(x) for x in calendar], "known_stations": [r.station_name for r in stations.select("station_name").collect()]}
    for name, column in (("known_operators", "operator"), ("known_relations", "relation")):
        out[name] = [r[0] for r in relation.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(sample).collect()]
    return out


def load(spark: SparkSession, snapshot: ProfileSnapshot, schema: str = "gold", sample: int = SAMPLE) -> tuple[dict, str]:
    """(profile, snapshot or measured). The snapshot counts only under the key it was written with: days and sums of the fact, not
    its dates alone. A snapshot that cannot be read or written never keeps the profile from being measured."""
    signal = spark.table(f"{schema}.fact_stop_event").agg(F.count(F.lit(1)), F.min("date_key"), F.max("date_key"), F.sum("stop_events")).first()
    key = {"sample": sample, "signal": [str(x) for x in signal]}
    held = snapshot.read(key)
    if held is not None:
        return held, "snapshot"
    found = measure(spark, schema, sample)
    try:
        snapshot.write(key, found)
    except OSError:
        pass
    return found, "measured"
