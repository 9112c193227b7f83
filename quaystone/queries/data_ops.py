"""Queries of the general data-processing operators over the whole test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators.heavy import heavy_counts, per_keys
from quaystone.operators.orphans import Reference, orphan_counts, orphan_references
from quaystone.operators.profile import Rule, ValueCountStore, as_value, load_shift, metrics, value_counts
from quaystone.operators.snapshots import snapshot_changes
from quaystone.operators.trailing import trailing_totals
from quaystone.session import cut, ensure_checkpoint_dir, measured_join, sizes_of, table

FACT_SHARE = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    snap = table(spark, d, "dim_station_snapshot")
    return snapshot_changes(snap, "snapshot_no", ["station_key"], ["station_name", "station_type"], "loaded_at")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("stations"))


def _references(spark: SparkSession, d: str) -> list[Reference]:
    return [
        Reference("station_key", table(spark, d, "dim_station"), "station_key", "loaded_at"),
        Reference("relation_key", table(spark, d, "dim_relation"), "relation_key", "loaded_at"),
        Reference("date_key", table(spark, d, "dim_date"), "date_key", "loaded_at"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cases = orphan_references(table(spark, d, "stg_fact_stop_event"), ["stg_id"], _references(spark, d), "loaded_at")
    return cases.select("stg_id", "ref_column", "ref_status")


def p3_orphans_by_load(spark: SparkSession, d: str) -> DataFrame:
    stg = table(spark, d, "stg_fact_stop_event").withColumn("landed_on", F.to_date("loaded_at"))
    cases = orphan_references(stg, ["stg_id", "load_no", "landed_on"], _references(spark, d), "loaded_at")
    return orphan_counts(cases, ["load_no", "landed_on"])


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(table(spark, d, "agg_station_day"), "station_key", "date_key", ["punctual_arrivals", "measured_arrivals"], (7, 30))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_counts(table(spark, d, "fact_stop_event"), ("station_key", "relation_key"), FACT_SHARE).select("key_column", "key_value")


def p5_results(spark: SparkSession, d: str) -> DataFrame:
    """Counts, delays and punctual share per station and per relation."""
    fact = table(spark, d, "fact_stop_event")
    late = F.col("delay_arr_s")
    partials = {
        "row_count": F.count(F.lit(1)),
        "stop_events": F.sum("stop_events"),
        "measured": F.sum("measured_arrivals"),
        "punctual": F.sum("punctual_arrivals"),
        "delays": F.count(late),
        "delay_sum": F.sum(late),
        "delay_min": F.min(late),
        "delay_max": F.max(late),
    }
    merges = {k: "sum" for k in partials} | {"delay_min": "min", "delay_max": "max"}
    both = per_keys(fact, ("station_key", "relation_key"), partials, merges, FACT_SHARE).drop("is_heavy")
    return both.withColumn("delay_avg", F.col("delay_sum") / F.nullif("delays", F.lit(0))).withColumn("punctual_share", F.col("punctual").cast("double") / F.nullif("measured", F.lit(0)))


#: A place: not empty, no white space at either end, neither > nor an arrow.
PLACE = r"[^\s>→](?:[^>→]*[^\s>→])?"
DIRECTION = rf"(?U)\A{PLACE} -> {PLACE}\z"


PROFILED = ("fact_stop_event", "dim_station", "dim_relation", "dim_date")
#: A direction can be judged beside its row's relation only, so the pair of both is counted too.
PAIR = "relation_and_direction"


def form_rules() -> list[Rule]:
    """The forms that values must have; the rules run on the value counts."""
    number, said = F.col("value_num"), F.from_json("value", "v struct<relation: string, relation_direction: string>")["v"]
    lead, text = F.concat(said["relation"], F.lit(": ")), said["relation_direction"]
    right = text.startswith(lead) & F.substring(text, F.length(lead) + 1, F.length(text)).rlike(DIRECTION)
    return [
        Rule("fact_stop_event", "punctual_arrivals", ~number.isin(0.0, 1.0)),
        Rule("dim_station", "ptcar_no", (number < 1) | (number > 9_999_999) | (F.col("n") >= 2)),
        Rule("dim_relation", "relation_direction", text.isNotNull() & ~F.coalesce(right, F.lit(False)), PAIR),
    ]


def _with_pair(relation: DataFrame) -> DataFrame:
    return relation.withColumn(PAIR, F.struct("relation", "relation_direction"))


def profile_store(spark: SparkSession, d: str, columns: dict[str, list[str]] | None = None, path: str | None = None) -> ValueCountStore:
    """The store of a folder's tables with two loads applied: the dimensions with the fact's history, and the fact's last week.

    ``columns`` by table, all of them if None. Under a ``path`` that holds a store already, loads applied before are not read again;
    without one a new store is made in the shared folder. The counts of both loads come from one pass over each column.
    """
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/value-counts-{uuid.uuid4()}"
    store = ValueCountStore(spark, path)
    if {"history", "last-week"} <= {load for _, load in store.versions()}:
        return store
    frames = {t: table(spark, d, t) for t in PROFILED}
    frames["dim_relation"] = _with_pair(frames["dim_relation"])
    fact = frames["fact_stop_event"]
    last = fact.agg(F.date_trunc("week", F.max("date_key")).cast("date").alias("w")).first()["w"]
    recent = F.coalesce(F.col("date_key") >= F.lit(last), F.lit(False))
    pick = lambda t: None if columns is None else columns.get(t, [])
    counted = cut(value_counts(fact, "fact_stop_event", pick("fact_stop_event"), by=F.when(recent, F.lit("last-week")).otherwise(F.lit("history"))))
    of = lambda load: counted.where(F.col("load") == load).drop("load")
    store.apply("history", of("history"), *[value_counts(frames[t], t, pick(t)) for t in PROFILED[1:] if pick(t) != []])
    store.apply("last-week", of("last-week"))
    return store


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose value breaks the form of its column: the offending values are taken from the maintained counts, their rows joined back."""
    rules = form_rules()
    store = profile_store(spark, d, {r.table: [r.counted or r.column] for r in rules})
    state = store.state([(r.table, r.counted or r.column) for r in rules])
    offenders = cut(state.where(reduce(lambda a, b: a | b, [r.on_state() for r in rules])).select("table_name", "value"))
    keys = {
        "fact_stop_event": F.concat_ws("|", F.col("date_key").cast("string"), "stop_point_key", F.col("train_no").cast("string")),
        "dim_station": F.col("station_key").cast("string"),
        "dim_relation": F.col("relation_key"),
    }
    mine = [offenders.where(F.col("table_name") == r.table).select(F.col("value").alias("__qs_bad")) for r in rules]
    parts = []
    for r, bad, size in zip(rules, mine, sizes_of(*mine)):
        df = table(spark, d, r.table)
        value, _ = as_value(_with_pair(df), r.counted) if r.counted else as_value(df, r.column)
        if r.counted:
            df = _with_pair(df)
        else:
            # Compared in the column's own type, which reaches the scan.
            value, bad = F.col(r.column), bad.select(F.col("__qs_bad").cast(df.schema[r.column].dataType).alias("__qs_bad"))
        rows = measured_join(df.select(value.alias("__qs_value"), keys[r.table].alias("row_key")), bad, "__qs_value", "__qs_bad", "inner", size, F.col("row_key"))
        parts.append(rows.select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), "row_key"))
    return reduce(DataFrame.unionByName, parts)


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile from maintained counts: the dimensions and the fact's history are one load, its last week is applied as a delta."""
    return metrics(profile_store(spark, d).state(), form_rules()).withColumns({c: F.round(c, 6) for c in ("null_rate", "entropy")})


def p6_shift(spark: SparkSession, d: str) -> DataFrame:
    """Shift of every fact column between the weekly loads, and of the station columns between deliveries."""
    fact = value_counts(table(spark, d, "fact_stop_event"), "fact_stop_event", by=F.date_trunc("week", "date_key").cast("date").cast("string"))
    snap = table(spark, d, "dim_station_snapshot").drop("snapshot_date")
    columns = [c for c in snap.columns if c not in ("snapshot_no", "loaded_at")]
    station = value_counts(snap, "dim_station_snapshot", columns, by=F.lpad(F.col("snapshot_no").cast("string"), 8, "0"))
    return load_shift(fact.unionByName(station)).withColumns({c: F.round(c, 6) for c in ("null_rate", "shift")})


def p6_shift_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Shift of every column of the relations and the calendar between the days on which their rows were loaded."""
    parts = [value_counts(table(spark, d, t), t, by=F.to_date("loaded_at").cast("string")) for t in ("dim_relation", "dim_date")]
    return load_shift(reduce(DataFrame.unionByName, parts)).withColumns({c: F.round(c, 6) for c in ("null_rate", "shift")})


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p3_found": p3_found,
    "p3_orphans_by_load": p3_orphans_by_load,
    "p4_trailing": p4_trailing,
    "p5_found": p5_found,
    "p5_results": p5_results,
    "p6_found": p6_found,
    "p6_profile": p6_profile,
    "p6_shift": p6_shift,
    "p6_shift_dimensions": p6_shift_dimensions,
}
