"""Queries over the star schema: scans, rules, joins, aggregates, rankings, set operations, merges, text, vectors, evaluation."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions import layout, text, vectors
from quaystone.functions.hashing import row_hash
from quaystone.operators import merge, quality, rollups
from quaystone.operators.ranks import exact_percentiles
from quaystone.operators.rollups import rate
from quaystone.operators.runlog import RunLog
from quaystone.plans.guard import Policy, UnsafeQuery, capped, validate
from quaystone.plans.lint import lint
from quaystone.schema import DIM_DATE, DIM_RELATION, DIM_STATION, EXPORT, FACT, STAR
from quaystone.session import cut, ensure_checkpoint_dir, read_text, table, write_text
from quaystone.sources.scan import ScanError, Scope, check_columns, coverage_gate, digests, is_partitioned, last_wins, read_blocks, read_manifest, read_table, violations, write_blocks

JULY = Scope(date(2026, 7, 1), date(2026, 8, 1))
#: Volume below which a key is not ranked.
LEAST_MEASURED = 100
TRACE_PROBS = (0.5, 0.95)


def _t(name):
    return lambda spark, d: table(spark, d, name)


_fact, _stg, _station, _relation, _date, _agg, _trace, _kb = map(_t, ("fact_stop_event", "stg_fact_stop_event", "dim_station", "dim_relation", "dim_date", "agg_station_day", "request_trace", "kb_chunk"))


def _july(df):
    return df.where(JULY.column())


def _flags(spark, d):
    return quality.flagged(_stg(spark, d), _date(spark, d), _station(spark, d), _relation(spark, d))


# --- scans ---------------------------------------------------------------------------------------------------------------


def s2_contract_violations(spark, d):
    parts = [violations(table(spark, d, n), t) for n, t in (("dim_date", DIM_DATE), ("dim_station", DIM_STATION), ("dim_relation", DIM_RELATION), ("fact_stop_event", FACT), ("stg_fact_stop_event", EXPORT))]
    return reduce(DataFrame.unionByName, parts)


def s3_typed_readers(spark, d):
    parts = []
    for t in (DIM_DATE, DIM_STATION, DIM_RELATION, FACT):
        df = read_table(spark, f"{d}/{t.name}.parquet", t, tolerate=("loaded_at",))
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t.name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def s7_range_scan(spark, d):
    return read_table(spark, f"{d}/fact_stop_event.parquet", FACT, Scope(date(2026, 8, 1), date(2026, 8, 4)), ["date_key", "station_key", "train_no", "delay_arr_s"], tolerate=("loaded_at",))


def s8_count_in_range(spark, d):
    return _july(_fact(spark, d)).agg(F.count(F.lit(1)).alias("rows"))


def s19_last_line_wins(spark, d):
    """Latest state per station of the repeated deliveries: the last row by delivery and arrival counts."""
    rows = table(spark, d, "dim_station_snapshot").select("station_key", "snapshot_no", "loaded_at", "station_name", "station_type")
    return last_wins(rows, ["station_key"], ["snapshot_no", "loaded_at", "station_name", "station_type"]).select("station_key", "snapshot_no", "station_name", "station_type")


# --- projections and predicates ------------------------------------------------------------------------------------------


def f1_open_scopes(spark, d):
    f = _fact(spark, d)
    ends = [("from", Scope(start=date(2026, 8, 1))), ("until", Scope(end=date(2026, 6, 15))), ("all", Scope())]
    return f.agg(*[F.count(F.when(s.column(), 1)).alias(n) for n, s in ends])


def f2_null_keys(spark, d):
    return _stg(spark, d).where(quality.any_null()).select("stg_id")


def f3_valid_rows(spark, d):
    return quality.valid(_flags(spark, d)).select("stg_id")


def f4_measured_derived(spark, d):
    measured = F.when(F.col("punctual_arrivals").isNull(), 0).otherwise(1).cast("short")
    return _fact(spark, d).groupBy(measured.alias("measured_arrivals"), "punctual_arrivals").agg(F.count(F.lit(1)).alias("rows"))


def f5_literal_range(spark, d):
    return _july(_fact(spark, d)).agg(F.sum("stop_events").alias("stop_events"), F.min("date_key").alias("first_day"), F.max("date_key").alias("last_day"))


def f6_named_station(spark, d):
    s = _station(spark, d).where("station_key <> -1 AND station_type = 'Station'")
    return s.groupBy("station_name").agg(F.count(F.lit(1)).alias("stations"), F.min("station_key").alias("first_key")).where("stations > 1")


def f7_distinct_from(spark, d):
    f = _fact(spark, d)
    return f.where(~F.col("delay_arr_s").eqNullSafe(F.col("delay_dep_s"))).groupBy("planned_hour").agg(F.count(F.lit(1)).alias("rows"))


def f8_positions_absent(spark, d):
    kb = _kb(spark, d)
    kept = kb.where("chunk_index < 3").select("doc_id", "chunk_index")
    return kb.select("doc_id", "chunk_index").join(kept, ["doc_id", "chunk_index"], "left_anti")


def _nearest_set(spark, d, k, **how):
    """Every vector whose id is divisible by 50 is a query, against all vectors."""
    e = table(spark, d, "embeddings")
    return vectors.nearest_set(e, e.where("vec_id % 50 = 0"), "embedding", k, "vec_id", **how)


def f9_excluded_before_limit(spark, d):
    near = _nearest_set(spark, d, 10, exclude=F.col("label").isin(0, 1), keep=["label"])
    return near.select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


def f10_floor_after_top(spark, d):
    return _nearest_set(spark, d, 20, floor=0.3).where("kept").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


def f11_coverage_tests(spark, d):
    c = _fact(spark, d).agg(F.min("date_key").alias("a"), F.max("date_key").alias("b"))
    day, past = F.lit(date(2026, 7, 15)), F.lit(date(2019, 3, 1))
    return c.select(
        (F.col("a") <= day) & (F.col("b") >= day), (F.col("a") <= past) & (F.col("b") >= past), (F.col("a") <= F.lit(date(2026, 12, 31))) & (F.col("b") >= F.lit(date(2026, 8, 1)))
    ).toDF("covers_july", "covers_2019", "overlaps_autumn")


# --- joins ---------------------------------------------------------------------------------------------------------------


def j1_station_rate(spark, d):
    f = _july(_fact(spark, d)).join(_station(spark, d).select("station_key", "station_name"), "station_key")
    return f.groupBy("station_name").agg(F.sum("punctual_arrivals").alias("punctual"), F.sum("measured_arrivals").alias("measured"), rate().alias("rate"))


def j2_relation_rate(spark, d):
    f = _july(_fact(spark, d)).join(_relation(spark, d).select("relation_key", "relation"), "relation_key")
    return f.groupBy("relation").agg(F.sum("measured_arrivals").alias("measured"), rate().alias("rate"))


def j3_weekend_by_calendar(spark, d):
    days = _date(spark, d).where("is_weekend").select("date_key", "month")
    return _fact(spark, d).join(days, "date_key").groupBy("month").agg(F.sum("stop_events").alias("stop_events"), rate().alias("rate"))


def j4_star(spark, d):
    f = _fact(spark, d).join(_station(spark, d).select("station_key", "station_type"), "station_key").join(_relation(spark, d).select("relation_key", "operator"), "relation_key").join(_date(spark, d).select("date_key", "day_name"), "date_key")
    return f.groupBy("station_type", "operator", "day_name").agg(F.sum("stop_events").alias("stop_events"), rate().alias("rate"))


def j5_station_activity(spark, d):
    return rollups.activity(_station(spark, d), _fact(spark, d)).select("station_key", "observed_stop_events")


def j7_orphan_stations(spark, d):
    return _stg(spark, d).where("station_key IS NOT NULL").join(_station(spark, d).select("station_key"), "station_key", "left_anti").select("stg_id", "station_key")


def j8_orphans_once(spark, d):
    return quality.integrity(_stg(spark, d), _date(spark, d), _station(spark, d), _relation(spark, d))


def j9_repeated_grain(spark, d):
    return _flags(spark, d).where("duplicate_grain").select("stg_id")


def j10_constant_join(spark, d):
    total = _fact(spark, d).agg(F.sum("stop_events").alias("total"))
    by = _fact(spark, d).groupBy("planned_hour").agg(F.sum("stop_events").alias("stop_events"))
    return by.join(total).select("planned_hour", "stop_events", (F.col("stop_events").cast("double") / F.col("total")).alias("share"))


def j11_cte_joined(spark, d):
    """Rows at least six minutes late, summed per relation in a common table expression, then per operator."""
    v = _views(spark, d)
    return spark.sql(
        f"""WITH late AS (SELECT relation_key, COUNT(*) AS late_rows, MAX(delay_arr_s) AS worst FROM {v["fact_stop_event"]} WHERE delay_arr_s >= 360 GROUP BY relation_key)
        SELECT r.operator, SUM(late.late_rows) AS late_rows, MAX(late.worst) AS worst FROM {v["dim_relation"]} r INNER JOIN late USING (relation_key) GROUP BY r.operator"""
    )


def j12_subqueries(spark, d):
    v = _views(spark, d)
    return spark.sql(
        f"""SELECT station_key, SUM(stop_events) AS events FROM {v["fact_stop_event"]} WHERE relation_key IN (SELECT relation_key FROM {v["dim_relation"]} WHERE operator = 'NVR')
        AND date_key > (SELECT MIN(date_key) FROM {v["fact_stop_event"]}) GROUP BY station_key"""
    )


def _views(spark, d):
    """Names of views over the folder's tables; each folder has its own, so that runs over several do not meet."""
    mark = hashlib.md5(d.encode()).hexdigest()[:12]
    names = {t: f"qs_{mark}_{t}" for t in ("fact_stop_event", "dim_relation")}
    for t, name in names.items():
        table(spark, d, t).createOrReplaceTempView(name)
    return names


# --- data quality --------------------------------------------------------------------------------------------------------


def q1_rule_counts(spark, d):
    return quality.rule_counts(_flags(spark, d))


def q6_rule_samples(spark, d):
    return quality.samples(_flags(spark, d))


def q8_integrity(spark, d):
    return quality.integrity(_fact(spark, d), _date(spark, d), _station(spark, d), _relation(spark, d))


def q10_dimension_counts(spark, d):
    claimed = {"dim_date": 10227, "dim_station": 4000, "dim_relation": 300}
    parts = [table(spark, d, n).agg(F.count(F.lit(1)).alias("found")).select(F.lit(n).alias("table_name"), F.lit(c).cast("long").alias("claimed"), "found") for n, c in claimed.items()]
    return reduce(DataFrame.unionByName, parts).where("claimed <> found")


def q12_freshness(spark, d):
    return rollups.freshness(_fact(spark, d), _agg(spark, d))


# --- aggregates ----------------------------------------------------------------------------------------------------------


def a1_rate(spark, d):
    return _july(_fact(spark, d)).agg(rate().alias("rate"))


def a2_full_period(spark, d):
    return _fact(spark, d).agg(rate().alias("rate"), F.sum("stop_events").alias("stop_events"))


def _ranking(spark, d, dim, key, name, ascending, k):
    f = _july(_fact(spark, d)).where("station_key <> -1").join(dim.select(key, name), key)
    ranked = f.groupBy(name).agg(rate().alias("rate"), F.sum("measured_arrivals").alias("measured")).where(F.col("measured") >= LEAST_MEASURED)
    return ranked.orderBy(F.asc_nulls_last("rate") if ascending else F.desc_nulls_last("rate"), name).limit(k).select(name, "rate")


def a3_worst_stations(spark, d):
    return _ranking(spark, d, _station(spark, d), "station_key", "station_name", True, 5)


def a3_best_stations(spark, d):
    return _ranking(spark, d, _station(spark, d), "station_key", "station_name", False, 3)


def a3_worst_relations(spark, d):
    return _ranking(spark, d, _relation(spark, d), "relation_key", "relation", True, 5)


def a4_by_month(spark, d):
    return _fact(spark, d).groupBy(F.month("date_key").alias("month")).agg(rate().alias("rate"), F.sum("stop_events").alias("stop_events"))


def a5_daily_series(spark, d):
    busiest = _agg(spark, d).where("station_key <> -1").groupBy("station_key").agg(F.sum("stop_events").alias("e")).orderBy(F.desc("e"), "station_key").limit(1)
    return _fact(spark, d).join(F.broadcast(busiest.select("station_key")), "station_key", "left_semi").groupBy("date_key").agg(rate().alias("rate"), F.sum("stop_events").alias("stop_events"))


def a6_station_rollup(spark, d):
    return rollups.rollup(_fact(spark, d), "station_key")


def a6_relation_rollup(spark, d):
    return rollups.rollup(_fact(spark, d), "relation_key")


def a7_rollup_difference(spark, d):
    return rollups.difference(_fact(spark, d), _agg(spark, d), "station_key")


def a7_stale_rollup(spark, d):
    """The rollup of the landed rows against that of the fact: days and stations whose sums differ, on either side."""
    landed = merge.promote(_stg(spark, d).where("date_key IS NOT NULL AND station_key IS NOT NULL"))
    return rollups.difference(landed, _agg(spark, d), "station_key")


def a8_rollup_by_month(spark, d):
    return rollups.coarser(_agg(spark, d), [F.month("date_key").alias("month"), "station_key"])


def a9_profile(spark, d):
    return rollups.coverage_profile(_fact(spark, d))


def a10_calendar(spark, d):
    return _date(spark, d).agg(F.min("date_key").alias("first_day"), F.max("date_key").alias("last_day"))


def a11_fact_window(spark, d):
    return _fact(spark, d).agg(F.min("date_key").alias("first_day"), F.max("date_key").alias("last_day"))


def a12_trains(spark, d):
    return _fact(spark, d).groupBy("date_key").agg(F.countDistinct("train_no").alias("trains"))


def a14_latest_load(spark, d):
    return _stg(spark, d).agg(F.max("load_no").alias("load_no"), F.max(F.to_date("loaded_at")).alias("landed_on"))


def a15_store_counts(spark, d):
    return _kb(spark, d).agg(F.count(F.lit(1)).alias("chunks"), F.count("content_hash").alias("hashed"), (F.count(F.lit(1)) - F.count("content_hash")).alias("pending"))


def a16_rows_per_year(spark, d):
    return _fact(spark, d).groupBy(F.year("date_key").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def _requests(spark, d, *columns):
    """The columns asked for, of every request once: what was logged twice is equal in all columns, told by a hash of 128 bits."""
    t = _trace(spark, d)
    return t.select(*[h.alias(f"__qs_h{i}") for i, h in enumerate(row_hash(t, t.columns))], *columns).distinct()


def a17_percentiles(spark, d):
    got = exact_percentiles(_requests(spark, d, "total_ms", "route"), ["route"], "total_ms", TRACE_PROBS, ["p50", "p95"])
    return got.select("route", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.col("n").alias("requests"))


def a18_report(spark, d):
    ok = F.col("error_class").isNull()
    return _requests(spark, d, "kind", "error_class").groupBy("kind").agg(F.count(F.lit(1)).alias("requests"), F.sum(ok.cast("long")).alias("succeeded"), (F.sum(ok.cast("long")).cast("double") / F.count(F.lit(1))).alias("success_rate"))


def a18_spans(spark, d):
    s = _requests(spark, d, "spans").select(F.explode("spans").alias("s")).select("s.*")
    got = exact_percentiles(s, ["name"], "duration_ms", TRACE_PROBS, ["p50", "p95"])
    return got.select("name", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.col("n").alias("spans"))


def a18_errors(spark, d):
    return _requests(spark, d, "error_class", "error_span").where("error_class IS NOT NULL").groupBy("error_class", "error_span").agg(F.count(F.lit(1)).alias("requests"))


# --- rankings ------------------------------------------------------------------------------------------------------------


def l1_busiest_days(spark, d):
    return _agg(spark, d).groupBy("date_key").agg(F.sum("stop_events").alias("stop_events")).orderBy(F.desc("stop_events"), "date_key").limit(10)


def l2_active_stations(spark, d):
    s = _station(spark, d).where("station_key <> -1 AND station_name IS NOT NULL")
    return s.orderBy(F.desc_nulls_last("observed_stop_events"), "station_key").limit(12).select("station_key", "station_name", "observed_stop_events")


def l3_operators(spark, d):
    return _relation(spark, d).where("operator IS NOT NULL").select("operator").distinct().orderBy("operator").limit(12)


def l6_nearest(spark, d):
    return _nearest_set(spark, d, 5, keep=["label"]).select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


def l8_pending_chunks(spark, d):
    return _kb(spark, d).where("content_hash IS NULL").orderBy("doc_id", "chunk_index").select("doc_id", "chunk_index", F.length("content").alias("chars"))


# --- set operations and merges -------------------------------------------------------------------------------------------


def u1_union(spark, d):
    return _fact(spark, d).select("station_key").union(_stg(spark, d).select("station_key")).distinct()


def u1_union_all(spark, d):
    a = _station(spark, d).select(F.lit("station").alias("kind"), F.col("station_type").alias("label"))
    b = _relation(spark, d).select(F.lit("relation").alias("kind"), F.col("operator").alias("label"))
    return a.unionByName(b).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("rows"))


def u2_multiset_difference(spark, d):
    a, b = _fact(spark, d).select("station_key", "planned_hour"), _stg(spark, d).select("station_key", "planned_hour")
    return b.exceptAll(a).groupBy("station_key", "planned_hour").agg(F.count(F.lit(1)).alias("rows"))


def _deliveries(spark, d):
    """The register as all deliveries but the last left it, and the last delivery, each station once."""
    snap = table(spark, d, "dim_station_snapshot").select("station_key", "snapshot_no", "loaded_at", "station_name", "station_type")
    last = snap.agg(F.max("snapshot_no").alias("last"))
    both = snap.join(F.broadcast(last))
    order = ["snapshot_no", "loaded_at", "station_name", "station_type"]
    return tuple(last_wins(both.where(side).drop("last"), ["station_key"], order).select("station_key", "station_name", "station_type") for side in ("snapshot_no < last", "snapshot_no = last"))


def w1_upsert(spark, d):
    old, new = _deliveries(spark, d)
    return merge.upsert(old, new, ["station_key"])


def w1_upsert_counts(spark, d):
    return w1_upsert(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("stations"))


def w2_replace_scope(spark, d):
    fact, fresh = _fact(spark, d), merge.promote(quality.valid(_flags(spark, d)))
    return merge.replace_scope(fact.select(*FACT.columns), fresh, Scope(date(2026, 8, 10), date(2026, 8, 20))).groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("stop_events").alias("stop_events"))


def w3_promote(spark, d):
    rows = merge.promote(quality.valid(_flags(spark, d)), Scope(date(2026, 8, 10), date(2026, 8, 20)))
    return rows.groupBy("date_key", "measured_arrivals").agg(F.count(F.lit(1)).alias("rows"), F.sum("punctual_arrivals").alias("punctual"))


def sync_sides(kb):
    """A store and its corpus, each with every row of ``kb``: the corpus hashed anew; the store as it stood, every fifth hash stale, and
    a quarter of the documents a section further down, so that their first position is new and their last is gone."""
    corpus = kb.select("doc_id", "chunk_index", text.content_hash(F.col("heading"), F.col("content")).alias("content_hash"))
    moved = (F.md5("doc_id") < "4").cast("int")
    hashed = F.when(F.col("chunk_index") % 5 == 0, F.lit("stale")).otherwise(F.col("content_hash"))
    return kb.select("doc_id", (F.col("chunk_index") + moved).alias("chunk_index"), hashed.alias("content_hash")), corpus


def w5_sync(spark, d):
    return merge.sync(*sync_sides(_kb(spark, d))).groupBy("outcome").agg(F.count(F.lit(1)).alias("positions"))


def w8_month_partitions(spark, d):
    return merge.month_partitions(spark, date(2026, 6, 1), date(2026, 8, 29))


def w8_outside_partitions(spark, d):
    return merge.outside(_stg(spark, d), date(2026, 8, 1), date(2026, 8, 31)).select("stg_id")


def c6_existing_partitions(spark, d):
    return _fact(spark, d).select(F.date_format("date_key", "'p'yyyy_MM").alias("partition_name")).distinct()


# --- text ----------------------------------------------------------------------------------------------------------------


def t3_hard_split(spark, d):
    return _kb(spark, d).select("doc_id", "chunk_index", F.posexplode(text.hard_split(F.col("content"), text.MAX_CHARS)).alias("piece_no", "piece")).select("doc_id", "chunk_index", "piece_no", F.md5("piece").alias("piece_md5"))


def t4_merge_short(spark, d):
    merged = text.merge_short(_kb(spark, d).select("doc_id", "chunk_index", F.coalesce("content", F.lit("")).alias("content")), "doc_id", "chunk_index", "content")
    return merged.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


def t5_content_hash(spark, d):
    return _kb(spark, d).select("doc_id", "chunk_index", text.content_hash(F.col("heading"), F.col("content")).alias("content_hash"))


def t7_flat_headings(spark, d):
    flat = text.folded(F.col("heading"))
    return _kb(spark, d).where("heading IS NOT NULL").groupBy(flat.alias("shape")).agg(F.count(F.lit(1)).alias("rows"))


def t8_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


def t9_question_print(spark, d):
    e = table(spark, d, "eval_item")
    h, n = text.question_print(F.col("item_text"))
    return e.select("item_id", h.alias("question_hash"), n.alias("question_length"))


def t10_route(spark, d):
    e = table(spark, d, "eval_item")
    return e.select("item_id", text.markers(F.col("item_text"), text.DATA_MARKERS).alias("data"), text.markers(F.col("item_text"), text.CONCEPT_MARKERS).alias("concept"), text.route(F.col("item_text")).alias("route"))


def d1_clusters(spark, d):
    s = _station(spark, d).where("latitude IS NOT NULL AND station_type IS NOT NULL").select("station_type", F.col("latitude").alias("y"))
    c = layout.clusters(s, ["station_type"], "y", 0.01)
    return c.select("station_type", "cluster_no", "members", F.round("centre", 4).alias("centre"))


def d4_running_lines(spark, d):
    """Lines that repeat over the sections of a knowledge document."""
    lines = _kb(spark, d).select("doc_id", "chunk_index", F.explode(F.split("content", "\n")).alias("line"))
    return layout.running_lines(lines, "doc_id", "chunk_index", "line", 0.5)


# --- vectors -------------------------------------------------------------------------------------------------------------


def v3_two_rankings(spark, d):
    every = _nearest_set(spark, d, 5).select("query_id", F.lit("all").alias("scope"), "vec_id")
    inner = _nearest_set(spark, d, 5, exclude=F.col("label") != 2).select("query_id", F.lit("label 2").alias("scope"), "vec_id")
    return every.unionByName(inner)


def v4_widths(spark, d):
    return vectors.widths(table(spark, d, "embeddings"), "embedding", 64)


def v5_pending(spark, d):
    e = table(spark, d, "embeddings").withColumn("model", F.when(F.col("label") == 0, F.lit(None).cast("string")).when(F.col("label") < 5, F.lit("m1")).otherwise(F.lit("m2")))
    return vectors.pending(e, "embedding", "model", "m2").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def c10_floor_shown(spark, d):
    return _nearest_set(spark, d, 12, floor=0.35).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "kept")


# --- evaluation ----------------------------------------------------------------------------------------------------------


#: Places of a ranking that count for the reciprocal rank.
RANKED = 10


def e3_hits(spark, d):
    """hit@4 and reciprocal rank of every vector whose id is divisible by 50: is a vector of its own label among the nearest others?"""
    e = table(spark, d, "embeddings")
    near = _nearest_set(spark, d, RANKED + 1, keep=["label"]).where("vec_id <> query_id")
    own = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    ranked = near.withColumn("place", place).where(F.col("place") <= RANKED).join(own, "query_id")
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("place"))).alias("place"))
    return first.select("query_id", F.coalesce(F.col("place") <= 4, F.lit(False)).alias("hit"), F.coalesce(F.lit(1.0) / F.col("place"), F.lit(0.0)).alias("reciprocal_rank"))


def e8_report(spark, d):
    return e3_hits(spark, d).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count(F.lit(1)).alias("cases"))


def e1_compared(spark, d):
    """The first and the last relations, each with a share, against each other and themselves, as tables that are compared."""
    from quaystone.evaluation.compare import Spec, compare

    keys = [[r.relation_key for r in _relation(spark, d).select("relation_key").orderBy(order).limit(k).collect()] for order, k in ((F.asc("relation_key"), 5), (F.desc("relation_key"), 3))]
    worst, best = ([(k, round((i + 1) / 7, 4)) for i, k in enumerate(some)] for some in keys)
    turned = [(round(share * 100, 1), name, "more") for name, share in reversed(worst)]
    cases = {
        "itself": (worst, worst, Spec("ordered")), "as_set_in_percent": (worst, turned, Spec("set", accept_percent=True)), "as_set_without_percent": (worst, turned, Spec("set")),
        "in_another_order": (worst, turned, Spec("ordered", accept_percent=True)), "another_ranking": (worst[:3], best, Spec("set")), "first_row_only": (worst, worst[:1] + worst[:0:-1], Spec("ordered", top_k=1)),
    }
    return spark.createDataFrame([(n, compare(*c)[0]) for n, c in cases.items()], "case_name string, agrees boolean")


# --- sources and sinks, written and read again -----------------------------------------------------------------------------


def _folder(spark, name):
    """A new folder in the shared place of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def s5_partitioned_range(spark, d):
    """The fact written as day folders, scanned by a range that prunes them, its key typed by the declaration."""
    path = _folder(spark, "fact-by-day")
    merge.publish(_fact(spark, d).select(*FACT.columns).repartition("date_key"), path, "date_key")
    if not is_partitioned(spark, path):
        raise ValueError("not laid out by day")
    f = read_table(spark, path, FACT, JULY, ["date_key", "station_key", "stop_events"])
    return f.groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("station_key").alias("stations"), F.sum("stop_events").alias("stop_events"))


def s6_column_differences(spark, d):
    """Columns that the landed batch has beside the fact's, and lacks."""
    try:
        check_columns(_stg(spark, d).columns, _fact(spark, d).columns, "batch")
        found = []
    except ScanError as e:
        found = [(side, c) for side, text in re.findall(r"(missing|unexpected) columns \[(.*?)\]", str(e)) for c in re.findall(r"'(.*?)'", text)]
    return spark.createDataFrame(found, "side string, column_name string")


def _manifest_of(spark, d):
    f = _fact(spark, d)
    years = {str(r.year): r.n for r in f.groupBy(F.year("date_key").alias("year")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = f.agg(F.min("date_key").alias("a"), F.max("date_key").alias("b")).first()
    dims = {n: table(spark, d, n).count() for n in ("dim_date", "dim_station", "dim_relation")}
    return {"contract_version": 2, "exported_at": "2026-09-01T00:00:00Z", "fact_stop_event": {"min_date_key": str(ends.a), "max_date_key": str(ends.b), "total_rows": sum(years.values()), "rows_per_year": years}, "dimensions": dims}


def s12_manifest(spark, d):
    """A manifest of the tables, written to the shared folder and read again."""
    path = f"{_folder(spark, 'manifest')}/manifest.json"
    write_text(spark, path, json.dumps(_manifest_of(spark, d)))
    m = read_manifest(read_text(spark, path))
    return spark.createDataFrame([("fact_stop_event", m.total_rows, m.first, m.last), *[(n, c, None, None) for n, c in m.dimensions.items()]], "table_name string, rows long, first_day date, last_day date")


def s13_blocks(spark, d):
    """Sections as a stream of blocks, one JSON line each, written and read again."""
    path = _folder(spark, "blocks")
    kb = _kb(spark, d)
    heads = kb.where("heading <> ''").select(F.lit("heading").alias("kind"), F.lit(None).cast("string").alias("section"), F.col("heading").alias("text"), F.lit(1).alias("level"))
    bodies = kb.where("content IS NOT NULL").select(F.lit("paragraph").alias("kind"), F.col("heading").alias("section"), F.col("content").alias("text"), F.lit(None).cast("int").alias("level"))
    write_blocks(heads.unionByName(bodies), path)
    b = read_blocks(spark, path)
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count("section").alias("in_section"), F.count("error").alias("errors"))


def q7_policies(spark, d):
    """Rows that a load of the batch publishes and rejects: nothing under ``fail``, the valid ones under ``skip``."""
    flags, out = cut(_flags(spark, d)), []
    for policy in ("fail", "skip"):
        fact, bad = merge.load_fact(flags, None, Scope(), policy)
        out.append((policy, fact.count() if fact is not None else 0, bad.count()))
    return spark.createDataFrame(out, "policy string, published long, rejected long")


def q11_gate(spark, d):
    """What the gate says to a whole load, one that lost a row, a range and a range with a row lost, and a range beyond the export."""
    m = read_manifest(json.dumps(_manifest_of(spark, d)))
    july = _july(_fact(spark, d)).count()
    loads = {"whole": (m.total_rows, m.total_rows, Scope()), "whole_short": (m.total_rows - 1, m.total_rows, Scope()), "range": (july, july, JULY), "range_short": (july - 1, july, JULY), "outside": (0, 0, Scope(date(2020, 1, 1), date(2020, 2, 1)))}
    return spark.createDataFrame([(n, not coverage_gate(m, *a)) for n, a in loads.items()], "load string, admitted boolean")


def w3_promote_last_landed(spark, d):
    """Every grain once, as it landed last."""
    keyed = _stg(spark, d).where(~quality.any_null())
    rows = merge.promote(keyed, order=["loaded_at", "stg_id"])
    return rows.groupBy("date_key", "measured_arrivals").agg(F.count(F.lit(1)).alias("rows"), F.sum("stop_events").alias("stop_events"), F.sum("delay_arr_s").alias("delay_sum"))


def w4_run_log(spark, d):
    """Three runs as the log tells them afterwards."""
    log = RunLog(spark, _folder(spark, "runs"))
    done, failed, _ = (log.start(n) for n in ("a", "b", "c"))
    log.finish(done, _stg(spark, d).count(), 0)
    log.fail(failed, "e" * 5000)
    return log.latest().select("from_source", "status", "rows_loaded", F.length("error").alias("error_chars"))


def t1_sections(spark, d):
    """Sections of the documents at their Markdown headings."""
    cut_ = text.sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return cut_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.count("heading").alias("headed"), F.sum(F.length("body")).alias("chars"))


def t2_packed(spark, d):
    """Pieces of every section of the knowledge documents."""
    kb = _kb(spark, d).select("doc_id", "chunk_index", F.posexplode(text.packed(F.col("content"), 600)).alias("piece_no", "piece"))
    return kb.select("doc_id", "chunk_index", "piece_no", F.md5("piece").alias("piece_md5"))


def _marks(spark, d):
    """Every section as a page with marks under up to four columns, at one height or two, and an underline."""
    kb = _kb(spark, d).select("doc_id", "chunk_index", F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    sides = F.transform(F.sequence(F.lit(0), F.col("n") % 4), lambda j: F.struct((F.lit(50.0) + 100 * j).alias("x0"), (F.lit(150.0) + 100 * j).alias("x1")))
    heights = F.array(F.lit(100.0), F.lit(100.0) + (F.col("n") % 7) * 10)
    under = kb.select("doc_id", "chunk_index", F.lit(70.0).alias("x0"), F.lit(130.0).alias("x1"), F.lit(300.0).alias("top"))
    drawn = kb.select("doc_id", "chunk_index", F.explode(sides).alias("s"), heights.alias("h")).select("doc_id", "chunk_index", "s.x0", "s.x1", F.explode("h").alias("top"))
    thick = kb.select("doc_id", "chunk_index", F.lit(0.0).alias("x0"), F.lit(500.0).alias("x1"), F.lit(400.0).alias("top"), F.lit(450.0).alias("bottom"))
    return drawn.unionByName(under).withColumn("bottom", F.col("top") + 1).unionByName(thick)


def d2_column_edges(spark, d):
    rules = layout.page_rules(_marks(spark, d), "doc_id", "chunk_index")
    return layout.column_edges(rules, _kb(spark, d).select("doc_id", "chunk_index"), "doc_id", "chunk_index").select("doc_id", F.posexplode("edges").alias("edge_no", "edge"))


def d2_row_edges(spark, d):
    rules = layout.page_rules(_marks(spark, d), "doc_id", "chunk_index")
    columns = layout.column_edges(rules, _kb(spark, d).select("doc_id", "chunk_index"), "doc_id", "chunk_index")
    return layout.row_edges(rules, columns, "doc_id", "chunk_index").select("doc_id", "chunk_index", F.posexplode("rows").alias("row_no", "y"))


def t6_glossary(spark, d):
    """Sections as rows of a glossary: those without a heading continue the entry before."""
    cells = F.create_map(F.lit("t"), F.coalesce("heading", F.lit("")), F.lit("x"), F.coalesce("content", F.lit("")))
    blocks = _kb(spark, d).select("doc_id", "chunk_index", F.lit("table_row").alias("kind"), F.col("profile").alias("section"), cells.alias("cells"))
    return text.glossary(blocks, "doc_id", "chunk_index", "t", {"x": "Meaning"}).select("doc_id", "chunk_index", "heading", F.md5("content").alias("content_md5"), "has_no_entry")


def s14_digests(spark, d):
    """Digests of files in the shared folder."""
    path = _folder(spark, "sources")
    for r in table(spark, d, "eval_item").select("suite").distinct().collect():
        write_text(spark, f"{path}/{r.suite}.txt", r.suite)
    return digests(spark, path)


def d5_lost_characters(spark, d):
    """Characters that the contents of a knowledge document hold less often than headings and contents together."""
    kb = _kb(spark, d)
    source = kb.select("doc_id", F.concat_ws(" ", "heading", "content").alias("t"))
    return layout.lost_characters(source, kb.select("doc_id", F.coalesce("content", F.lit("")).alias("t")), ["doc_id"], "t")


def g1_guard(spark, d):
    """Statements and whether the guard admits them."""
    policy = Policy(frozenset({"gold.dim_date"}))
    out = []
    for statement in GUARDED:
        try:
            validate(spark, statement, policy)
            out.append((statement, True))
        except UnsafeQuery:
            out.append((statement, False))
    return spark.createDataFrame(out, "statement string, admitted boolean")


#: Plain statements, so that the guard can be held against their listing in the SQL.
GUARDED = (
    "SELECT 1 AS one", "SELECT year FROM dim_date", "SELECT max(year) FROM gold.dim_date", "SELECT year FROM gold.dim_date UNION SELECT month FROM gold.dim_date", "SELECT key FROM vault", "DELETE FROM gold.dim_date", "SELECT year FROM gold.dim_date; SELECT 2",
    "SHOW DATABASES", "SELECT java_method(year) FROM gold.dim_date", "SELECT year FROM gold.dim_date EXCEPT SELECT month FROM gold.dim_date",
)


def g8_lint(spark, d):
    """Conditions on a fact and whether its partition key is bounded by constants."""
    tables = {t.name: (t.partitioned_by or "", frozenset(t.columns)) for t in STAR.values()}
    out = [(c, bool(lint(spark, f"SELECT count(*) FROM gold.fact_stop_event f WHERE {c}", tables))) for c in LINTED]
    return spark.createDataFrame(out, "condition string, flagged boolean")


LINTED = (
    "f.train_no > 5", "f.date_key = DATE '2026-06-02'", "f.date_key >= DATE '2026-06-02' AND f.train_no > 5", "f.date_key >= DATE '2026-06-02' OR f.train_no > 5", "f.date_key IN (DATE '2026-06-02', DATE '2026-06-09')",
    "f.date_key = f.loaded_at", "f.date_key < (SELECT max(date_key) FROM gold.dim_date)", "month(f.date_key) = 6",
)


def l4_row_cap(spark, d):
    """Rows of a ranking under caps, with the query's own limit and without."""
    name = _views(spark, d)["dim_relation"]
    policy = Policy(frozenset({f"gold.{name}"}), max_rows=20)
    out = []
    for limit in ("", "LIMIT 7", "LIMIT 1000"):
        q = validate(spark, f"SELECT relation_key FROM {name} ORDER BY relation_key {limit}", policy)
        out.append((limit, capped(spark, q).count()))
    return spark.createDataFrame(out, "own_limit string, rows long")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "sfjqaluwctdveg" and n[1:2].isdigit()}

__all__ = ["QUERIES", "SparkSession", "Window"]
