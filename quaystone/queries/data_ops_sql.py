"""The same results in DuckDB SQL."""

from quaystone import schema

_P1 = """
WITH latest AS (
  SELECT snapshot_no, station_key, arg_max({'n': station_name, 't': station_type}, loaded_at) AS s
  FROM dim_station_snapshot WHERE station_key IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY 1, 2),
calendar AS (SELECT n AS later, lag(n) OVER (ORDER BY n) AS earlier FROM (SELECT DISTINCT snapshot_no AS n FROM dim_station_snapshot)),
l AS (SELECT c.later, station_key, s FROM latest JOIN calendar c ON snapshot_no = c.later WHERE c.earlier IS NOT NULL),
e AS (SELECT c.later, station_key, s FROM latest JOIN calendar c ON snapshot_no = c.earlier),
found AS (
  SELECT coalesce(l.later, e.later) AS snapshot_no, coalesce(l.station_key, e.station_key) AS station_key,
         CASE WHEN e.station_key IS NULL THEN 'added' WHEN l.station_key IS NULL THEN 'removed'
              WHEN l.s.n IS DISTINCT FROM e.s.n OR l.s.t IS DISTINCT FROM e.s.t THEN 'changed' END AS change_kind
  FROM l FULL JOIN e ON l.later = e.later AND l.station_key = e.station_key)
"""

_P3 = """
WITH refs AS (
  SELECT stg_id, load_no, loaded_at, 'station_key' AS ref_column, CAST(station_key AS VARCHAR) AS v FROM stg_fact_stop_event
  UNION ALL SELECT stg_id, load_no, loaded_at, 'relation_key', relation_key FROM stg_fact_stop_event
  UNION ALL SELECT stg_id, load_no, loaded_at, 'date_key', CAST(date_key AS VARCHAR) FROM stg_fact_stop_event),
keys AS (
  SELECT 'station_key' AS c, CAST(station_key AS VARCHAR) AS k, min(loaded_at) AS since FROM dim_station GROUP BY 1, 2
  UNION ALL SELECT 'relation_key', relation_key, min(loaded_at) FROM dim_relation GROUP BY 1, 2
  UNION ALL SELECT 'date_key', CAST(date_key AS VARCHAR), min(loaded_at) FROM dim_date GROUP BY 1, 2),
found AS (
  SELECT stg_id, load_no, CAST(loaded_at AS DATE) AS landed_on, ref_column, v, CASE WHEN k IS NULL THEN 'missing' ELSE 'late' END AS ref_status
  FROM refs LEFT JOIN keys ON c = ref_column AND k = v WHERE v IS NOT NULL AND (k IS NULL OR since > loaded_at))
"""

_TRAIL = ", ".join(
    f"CAST(sum(coalesce({m}, 0)) OVER w{w} AS BIGINT) AS {m}_{w}d, CAST(sum(coalesce({m}, 0)) OVER w{w} AS DOUBLE) / least({w}, day_no + 1) AS {m}_{w}d_avg" for w in (7, 30) for m in ("punctual_arrivals", "measured_arrivals")
)

_KEY = """SELECT '{k}' AS key_column, CAST({k} AS VARCHAR) AS key_value, count(*) AS row_count, CAST(sum(stop_events) AS BIGINT) AS stop_events,
  CAST(sum(measured_arrivals) AS BIGINT) AS measured, CAST(sum(punctual_arrivals) AS BIGINT) AS punctual, count(delay_arr_s) AS delays,
  CAST(sum(delay_arr_s) AS BIGINT) AS delay_sum, min(delay_arr_s) AS delay_min, max(delay_arr_s) AS delay_max,
  CAST(sum(delay_arr_s) AS DOUBLE) / nullif(count(delay_arr_s), 0) AS delay_avg,
  CAST(sum(punctual_arrivals) AS DOUBLE) / nullif(CAST(sum(measured_arrivals) AS BIGINT), 0) AS punctual_share
  FROM fact_stop_event GROUP BY {k}"""

_PLACE = r"[^\s>→]([^>→]*[^\s>→])?"

_NUMBERS = (schema.SHORT, schema.INT, schema.LONG, schema.DOUBLE)


def _columns(name):
    kinds = {c: k for c, (k, _, _) in schema.STAR["dim_station" if name == "dim_station_snapshot" else name].columns.items()}
    return kinds | {"loaded_at": schema.TIME}


def _as_text(column, kind):
    return f"strftime({column} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')" if kind is schema.TIME else f"CAST({column} AS VARCHAR)"


_DIRECTION = rf"""NOT coalesce(starts_with(relation_direction, relation || ': ') AND regexp_full_match(substring(relation_direction, length(relation) + 3), '{_PLACE} -> {_PLACE}'), false)"""
_BROKEN = {
    ("fact_stop_event", "punctual_arrivals"): "CAST(coalesce(sum(n) FILTER (WHERE punctual_arrivals NOT IN (0, 1)), 0) AS BIGINT)",
    ("dim_station", "ptcar_no"): "CAST(coalesce(sum(n) FILTER (WHERE ptcar_no < 1 OR ptcar_no > 9999999 OR (ptcar_no IS NOT NULL AND n > 1)), 0) AS BIGINT)",
    ("dim_relation", "relation_direction"): f"(SELECT count(*) FROM dim_relation WHERE relation_direction IS NOT NULL AND {_DIRECTION})",
}


def _profile(name):
    parts = []
    for c, kind in _columns(name).items():
        low, high = (f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)") if kind in _NUMBERS else ("min(v)", "max(v)")
        parts.append(
            f"""SELECT '{name}' AS table_name, '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS nulls,
            round(coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::DOUBLE / sum(n), 6) AS null_rate, count(v) AS distinct_values, {low} AS min_value, {high} AS max_value,
            round(ln(sum(n) FILTER (WHERE v IS NOT NULL)) - sum(n * ln(n)) FILTER (WHERE v IS NOT NULL) / sum(n) FILTER (WHERE v IS NOT NULL), 6) AS entropy, max(n) FILTER (WHERE v IS NOT NULL) AS top_count, {_BROKEN.get((name, c), 'CAST(NULL AS BIGINT)')} AS violations
            FROM (SELECT {c}, {_as_text(c, kind)} AS v, count(*) AS n FROM {name} GROUP BY 1, 2)"""
        )
    return " UNION ALL ".join(parts)


def _shift(name, columns, load):
    return " UNION ALL ".join(
        f"""SELECT * FROM (WITH c AS (SELECT load, v, count(*) AS n FROM (SELECT {load} AS load, {_as_text(c, k)} AS v FROM {name}) GROUP BY 1, 2),
        t AS (SELECT load, CAST(sum(n) AS BIGINT) AS total, coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS nulls, lead(load) OVER (ORDER BY load) AS after, row_number() OVER (ORDER BY load) AS no FROM c GROUP BY 1),
        s AS (SELECT load AS dl, v, n::DOUBLE / total AS p FROM c JOIN t USING (load) UNION ALL SELECT after, v, -n::DOUBLE / total FROM c JOIN t USING (load) WHERE after IS NOT NULL),
        m AS (SELECT dl, sum(abs(d)) / 2 AS shift FROM (SELECT dl, v, sum(p) AS d FROM s GROUP BY 1, 2) GROUP BY 1)
        SELECT '{name}' AS table_name, '{c}' AS column_name, t.load AS load, total AS rows, round(nulls::DOUBLE / total, 6) AS null_rate, CASE WHEN no > 1 THEN round(shift, 6) END AS shift FROM t JOIN m ON dl = t.load)"""
        for c, k in columns.items()
    )


_WEEK = "CAST(CAST(date_trunc('week', date_key) AS DATE) AS VARCHAR)"
_DELIVERY = "lpad(CAST(snapshot_no AS VARCHAR), 8, '0')"

SQL = {
    "p6_profile": " UNION ALL ".join(_profile(t) for t in ("fact_stop_event", "dim_station", "dim_relation", "dim_date")),
    "p6_shift": _shift("fact_stop_event", _columns("fact_stop_event"), _WEEK) + " UNION ALL " + _shift("dim_station_snapshot", {c: k for c, k in _columns("dim_station_snapshot").items() if c != "loaded_at"}, _DELIVERY),
    "p6_shift_dimensions": " UNION ALL ".join(_shift(t, _columns(t), "CAST(CAST(loaded_at AS DATE) AS VARCHAR)") for t in ("dim_relation", "dim_date")),
    "p1_found": _P1 + "SELECT * FROM found WHERE change_kind IS NOT NULL",
    "p1_counts": _P1 + "SELECT snapshot_no, change_kind, count(*) AS stations FROM found WHERE change_kind IS NOT NULL GROUP BY 1, 2",
    "p3_found": _P3 + "SELECT stg_id, ref_column, ref_status FROM found",
    "p3_orphans_by_load": _P3 + "SELECT load_no, landed_on, ref_column, ref_status, count(*) AS orphans, count(DISTINCT v) AS orphan_keys FROM found GROUP BY 1, 2, 3, 4",
    "p4_trailing": f"""
WITH span AS (SELECT min(date_key) AS a, max(date_key) AS b FROM agg_station_day),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date_key, a FROM span),
dense AS (SELECT s.station_key, days.date_key, date_diff('day', a, days.date_key) AS day_no FROM (SELECT DISTINCT station_key FROM agg_station_day) s CROSS JOIN days)
SELECT station_key, date_key, g.station_key IS NOT NULL AS has_row, CAST(least(7, day_no + 1) AS INTEGER) AS days_7d, CAST(least(30, day_no + 1) AS INTEGER) AS days_30d, {_TRAIL}
FROM dense LEFT JOIN agg_station_day g USING (station_key, date_key)
WINDOW w7 AS (PARTITION BY station_key ORDER BY date_key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY station_key ORDER BY date_key ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "p5_found": " UNION ALL ".join(f"SELECT '{k}' AS key_column, CAST({k} AS VARCHAR) AS key_value FROM fact_stop_event WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= 0.04 * (SELECT count(*) FROM fact_stop_event)" for k in ("station_key", "relation_key")),
    "p5_results": " UNION ALL ".join(_KEY.format(k=k) for k in ("station_key", "relation_key")),
    "p6_found": rf"""
SELECT 'fact_stop_event' AS table_name, 'punctual_arrivals' AS column_name, concat_ws('|', CAST(date_key AS VARCHAR), stop_point_key, CAST(train_no AS VARCHAR)) AS row_key
FROM fact_stop_event WHERE punctual_arrivals NOT IN (0, 1)
UNION ALL SELECT 'dim_station', 'ptcar_no', CAST(station_key AS VARCHAR) FROM dim_station
WHERE ptcar_no < 1 OR ptcar_no > 9999999 OR ptcar_no IN (SELECT ptcar_no FROM dim_station WHERE ptcar_no IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dim_relation', 'relation_direction', relation_key FROM dim_relation
WHERE relation_direction IS NOT NULL AND NOT coalesce(starts_with(relation_direction, relation || ': ')
  AND regexp_full_match(substring(relation_direction, length(relation) + 3), '{_PLACE} -> {_PLACE}'), false)""",
}
