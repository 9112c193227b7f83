"""The same results in DuckDB SQL."""

from quaystone.functions.text import MAX_CHARS, MIN_CHARS
from quaystone.queries.star import LEAST_MEASURED
from quaystone.schema import DIM_DATE, DIM_RELATION, DIM_STATION, EXPORT, FACT

RATE = "CAST(sum(punctual_arrivals) AS DOUBLE) / nullif(CAST(sum(measured_arrivals) AS BIGINT), 0)"
JULY = "date_key >= DATE '2026-07-01' AND date_key < DATE '2026-08-01'"
KEYS = ("date_key", "station_key", "stop_point_key", "relation_key", "train_no")
NULL_KEY = " OR ".join(f"{k} IS NULL" for k in KEYS)
#: The batch with its five flags.
FLAGS = f"""
WITH keyed AS (SELECT *, ({NULL_KEY}) AS null_keys FROM stg_fact_stop_event),
many AS (SELECT date_key, stop_point_key, train_no FROM keyed WHERE NOT null_keys GROUP BY ALL HAVING count(*) > 1),
flags AS (SELECT k.*, NOT null_keys AND EXISTS (SELECT 1 FROM many m WHERE m.date_key = k.date_key AND m.stop_point_key = k.stop_point_key AND m.train_no = k.train_no) AS duplicate_grain,
  date_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_date x WHERE x.date_key = k.date_key) AS orphan_date,
  station_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_station x WHERE x.station_key = k.station_key) AS orphan_station,
  relation_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_relation x WHERE x.relation_key = k.relation_key) AS orphan_relation FROM keyed k)
"""
RULES = ("null_keys", "duplicate_grain", "orphan_date", "orphan_station", "orphan_relation")
VALID = "NOT (" + " OR ".join(RULES) + ")"
SUMS = "count(*) AS row_count, CAST(sum(stop_events) AS BIGINT) AS stop_events, CAST(sum(measured_arrivals) AS BIGINT) AS measured_arrivals, CAST(coalesce(sum(punctual_arrivals), 0) AS BIGINT) AS punctual_arrivals"


def _ranking(dim, key, name, order, k):
    return f"""SELECT {name}, rate FROM (SELECT {name}, {RATE} AS rate FROM fact_stop_event JOIN {dim} USING ({key}) WHERE {JULY} AND station_key <> -1
    GROUP BY {name} HAVING sum(measured_arrivals) >= {LEAST_MEASURED}) ORDER BY rate {order} NULLS LAST, {name} LIMIT {k}"""


def _violations():
    parts = []
    for name, t in (("dim_date", DIM_DATE), ("dim_station", DIM_STATION), ("dim_relation", DIM_RELATION), ("fact_stop_event", FACT), ("stg_fact_stop_event", EXPORT)):
        checks = {f"{c}_required": f"{c} IS NULL" for c, (_, nullable, _) in t.columns.items() if not nullable} | {r: f"NOT ({x.replace('IF(punctual_arrivals IS NULL, 0, 1)', 'CASE WHEN punctual_arrivals IS NULL THEN 0 ELSE 1 END')})" for r, x in t.rules.items()}
        parts += [f"SELECT '{t.name}' AS table_name, '{r}' AS rule, count(*) FILTER (WHERE {x}) AS rows_failed FROM {name}" for r, x in checks.items()]
    return " UNION ALL ".join(parts)




def _near_set(k, where="true"):
    """The k nearest to every vector whose id is divisible by 50."""
    return f"""(SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND {where})
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= {k})"""


REQUESTS = "(SELECT DISTINCT * FROM request_trace)"
_BLANK = r" \t\n\x0B\f\r"
_ENDS = """WITH z AS (SELECT max(snapshot_no) AS b FROM dim_station_snapshot),
o AS (SELECT station_key, struct_pack(n := station_name, t := station_type) AS v FROM dim_station_snapshot, z WHERE snapshot_no < b QUALIFY row_number() OVER (PARTITION BY station_key ORDER BY snapshot_no DESC, loaded_at DESC NULLS LAST, station_name DESC NULLS LAST, station_type DESC NULLS LAST) = 1),
n AS (SELECT station_key, struct_pack(n := station_name, t := station_type) AS v FROM dim_station_snapshot, z WHERE snapshot_no = b QUALIFY row_number() OVER (PARTITION BY station_key ORDER BY loaded_at DESC NULLS LAST, station_name DESC NULLS LAST, station_type DESC NULLS LAST) = 1),
up AS (SELECT station_key, CASE WHEN n.station_key IS NULL THEN o.v ELSE n.v END AS v, CASE WHEN n.station_key IS NULL THEN 'kept' WHEN o.station_key IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM o FULL JOIN n USING (station_key))
"""
_HITS = """WITH r AS (SELECT q.vec_id AS query_id, q.label AS wanted, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS place
  FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
hits AS (SELECT query_id, coalesce(min(place) FILTER (WHERE label = wanted AND place <= 10) <= 4, false) AS hit, coalesce(1.0::DOUBLE / min(place) FILTER (WHERE label = wanted AND place <= 10), 0.0::DOUBLE) AS reciprocal_rank FROM r GROUP BY 1)
"""
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _flat(column):
    return f"trim(regexp_replace({column}, '{_SPACE}+', ' ', 'g'))"


#: Of a question's words only: what asks for figures, what asks for meaning, as listed for the router.
_ASKS_DATA = """how many|how much|which station|which stations|which train|which relation|which operator|worst|best|highest|lowest|most delayed|least|top |rank|average delay|total|count|compare|trend|per day|per hour|per station|by station|by hour|by month|last week|last month|list |show me"""
_ASKS_CONCEPT = """why is|why are|why does|why do|what does it mean|what is meant|how is punctuality|how do you define|how is it defined|what does|how does the|how was|where does the data|who publishes|explain|definition|architecture|limitation|known issue|modelled|modeled|design"""
_COUNTED = "len(list_filter(string_split('{0}', '|'), lambda m: contains(lower(item_text), m)))"

_MARKS = """WITH k AS (SELECT doc_id, chunk_index, coalesce(length(content), 0) AS n FROM kb_chunk),
marks AS (SELECT DISTINCT doc_id, chunk_index, 50.0::DOUBLE + 100 * j AS x0, 150.0::DOUBLE + 100 * j AS x1, y + 0.5::DOUBLE AS y
  FROM (SELECT *, unnest(range(n % 4 + 1)) AS j FROM k), LATERAL (SELECT unnest([100.0::DOUBLE, 100.0::DOUBLE + (n % 7) * 10]) AS y)),
ends AS (SELECT doc_id, chunk_index, x0 AS edge, y FROM marks UNION SELECT doc_id, chunk_index, x1, y FROM marks),
voted AS (SELECT doc_id, chunk_index, edge FROM ends GROUP BY 1, 2, 3 HAVING count(DISTINCT y) >= 2),
pages AS (SELECT doc_id, count(*) AS total FROM k GROUP BY 1),
edges AS (SELECT doc_id, edge FROM voted JOIN pages USING (doc_id) GROUP BY doc_id, edge, total HAVING count(*) >= greatest(1, floor(total * 0.5)))
"""

SQL = {
    "a7_stale_rollup": f"""WITH b AS (SELECT date_key, station_key, count(*) AS row_count, CAST(sum(stop_events) AS BIGINT) AS stop_events, CAST(sum(CASE WHEN punctual_arrivals IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS measured_arrivals, CAST(coalesce(sum(punctual_arrivals), 0) AS BIGINT) AS punctual_arrivals
      FROM stg_fact_stop_event WHERE date_key IS NOT NULL AND station_key IS NOT NULL GROUP BY 1, 2), k AS (SELECT date_key, station_key, row_count, stop_events, measured_arrivals, punctual_arrivals FROM agg_station_day)
      SELECT *, 'fact' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM k) UNION ALL SELECT *, 'rollup' FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM b)""",
    "j11_cte_joined": "SELECT operator, CAST(count(*) AS BIGINT) AS late_rows, max(delay_arr_s) AS worst FROM fact_stop_event f, dim_relation r WHERE f.relation_key = r.relation_key AND delay_arr_s >= 360 GROUP BY 1",
    "s5_partitioned_range": f"SELECT date_key, count(*) AS rows, count(DISTINCT station_key) AS stations, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM fact_stop_event WHERE {JULY} GROUP BY 1",
    "s6_column_differences": """SELECT 'missing' AS side, column_name FROM (SELECT column_name FROM (DESCRIBE fact_stop_event) EXCEPT SELECT column_name FROM (DESCRIBE stg_fact_stop_event))
      UNION ALL SELECT 'unexpected', column_name FROM (SELECT column_name FROM (DESCRIBE stg_fact_stop_event) EXCEPT SELECT column_name FROM (DESCRIBE fact_stop_event))""",
    "s12_manifest": "SELECT 'fact_stop_event' AS table_name, count(*) AS rows, min(date_key) AS first_day, max(date_key) AS last_day FROM fact_stop_event" + "".join(f" UNION ALL SELECT '{n}', count(*), NULL, NULL FROM {n}" for n in ("dim_date", "dim_station", "dim_relation")),
    "s13_blocks": """SELECT 'heading' AS kind, count(*) AS blocks, CAST(sum(length(heading)) AS BIGINT) AS chars, 0 AS in_section, 0 AS errors FROM kb_chunk WHERE heading <> ''
      UNION ALL SELECT 'paragraph', count(*), CAST(sum(length(content)) AS BIGINT), count(heading), 0 FROM kb_chunk WHERE content IS NOT NULL""",
    "q7_policies": FLAGS + f"SELECT 'fail' AS policy, 0 AS published, count(*) FILTER (WHERE NOT ({VALID})) AS rejected FROM flags UNION ALL SELECT 'skip', count(*) FILTER (WHERE {VALID}), count(*) FILTER (WHERE NOT ({VALID})) FROM flags",
    "q11_gate": "SELECT * FROM (VALUES ('whole', true), ('whole_short', false), ('range', true), ('range_short', false), ('outside', false)) t(load, admitted)",
    "w3_promote_last_landed": f"""WITH k AS (SELECT * FROM stg_fact_stop_event WHERE NOT ({NULL_KEY}) QUALIFY row_number() OVER (PARTITION BY date_key, stop_point_key, train_no ORDER BY loaded_at DESC, stg_id DESC) = 1)
      SELECT date_key, CAST(CASE WHEN punctual_arrivals IS NULL THEN 0 ELSE 1 END AS SMALLINT) AS measured_arrivals, count(*) AS rows, CAST(sum(stop_events) AS BIGINT) AS stop_events, CAST(sum(delay_arr_s) AS BIGINT) AS delay_sum FROM k GROUP BY 1, 2""",
    "w4_run_log": "SELECT 'a' AS from_source, 'succeeded' AS status, count(*) AS rows_loaded, CAST(NULL AS INTEGER) AS error_chars FROM stg_fact_stop_event UNION ALL SELECT 'b', 'failed', NULL, 2000 UNION ALL SELECT 'c', 'running', NULL, NULL",
    "t1_sections": rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS i FROM documents WHERE text IS NOT NULL),
      h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \t\n\x0B\f\r]') AS is_head FROM l), g AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
      b AS (SELECT doc_id, no, bool_or(is_head) AS headed, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_head), ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS body FROM g GROUP BY 1, 2)
      SELECT doc_id, count(*) AS sections, count(*) FILTER (WHERE headed) AS headed, CAST(sum(length(body)) AS BIGINT) AS chars FROM b WHERE body <> '' GROUP BY 1""",
    "t2_packed": rf"""WITH RECURSIVE k AS (SELECT doc_id, chunk_index, content, regexp_split_to_array(content, '\n{_SPACE}*\n') AS ps FROM kb_chunk WHERE content IS NOT NULL),
      fold AS (SELECT doc_id, chunk_index, ps, 0 AS i, '' AS buf, CAST([] AS VARCHAR[]) AS parts FROM k WHERE length(content) > 600
        UNION ALL SELECT doc_id, chunk_index, ps, i + 1,
          CASE WHEN length(CASE WHEN buf = '' THEN ps[i + 1] ELSE buf || chr(10) || chr(10) || ps[i + 1] END) <= 600 THEN CASE WHEN buf = '' THEN ps[i + 1] ELSE buf || chr(10) || chr(10) || ps[i + 1] END WHEN length(ps[i + 1]) <= 600 THEN ps[i + 1] ELSE '' END,
          CASE WHEN length(CASE WHEN buf = '' THEN ps[i + 1] ELSE buf || chr(10) || chr(10) || ps[i + 1] END) <= 600 THEN parts ELSE list_concat(CASE WHEN buf = '' THEN parts ELSE list_append(parts, buf) END,
            CASE WHEN length(ps[i + 1]) <= 600 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(CAST(ceil(length(ps[i + 1]) / 600.0) AS BIGINT)), lambda n: substring(ps[i + 1], CAST(n * 600 + 1 AS BIGINT), 600)) END) END
        FROM fold WHERE i < len(ps)),
      whole AS (SELECT doc_id, chunk_index, CASE WHEN buf = '' THEN parts ELSE list_append(parts, buf) END AS parts FROM fold WHERE i = len(ps) UNION ALL SELECT doc_id, chunk_index, [content] FROM k WHERE length(content) <= 600)
      SELECT doc_id, chunk_index, CAST(n AS INTEGER) AS piece_no, md5(parts[n + 1]) AS piece_md5 FROM (SELECT *, unnest(range(len(parts))) AS n FROM whole)""",
    "d2_column_edges": _MARKS + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY edge) - 1 AS INTEGER) AS edge_no, edge FROM edges WHERE doc_id IN (SELECT doc_id FROM edges GROUP BY 1 HAVING count(*) >= 2)",
    "d2_row_edges": _MARKS
    + """, fits AS (SELECT DISTINCT m.doc_id, m.chunk_index, m.y FROM marks m JOIN edges a ON a.doc_id = m.doc_id AND a.edge = m.x0 JOIN edges b ON b.doc_id = m.doc_id AND b.edge = m.x1),
      many AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chunk_index) AS n FROM fits) SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY y) - 1 AS INTEGER) AS row_no, y FROM many WHERE n >= 2""",
    "t6_glossary": f"""WITH r AS (SELECT doc_id, chunk_index, profile, {_flat("coalesce(heading, '')")} AS term, trim(coalesce(content, ''), ' ') AS body FROM kb_chunk),
      e AS (SELECT *, sum(CASE WHEN term <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS entry FROM r),
      f AS (SELECT doc_id, entry, arg_min(profile, chunk_index) AS section, arg_min(term, chunk_index) AS term, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE body <> ''), '') AS content FROM e GROUP BY 1, 2)
      SELECT doc_id, CAST(entry - 1 AS BIGINT) AS chunk_index, section || ' — ' || term AS heading, md5(CASE WHEN content = '' THEN term ELSE content END) AS content_md5, entry = 0 AS has_no_entry FROM f""",
    "s14_digests": "SELECT DISTINCT suite || '.txt' AS file, sha256(suite) AS sha256 FROM eval_item",
    "d5_lost_characters": r"""SELECT doc_id, c AS "char", count(*) AS lost FROM (SELECT doc_id, unnest(string_split(regexp_replace(heading, '[ \t\n\x0B\f\r]+', '', 'g'), '')) AS c FROM kb_chunk WHERE heading IS NOT NULL) WHERE c <> '' GROUP BY 1, 2""",
    "g1_guard": """SELECT * FROM (VALUES ('SELECT 1 AS one', true), ('SELECT year FROM dim_date', true), ('SELECT max(year) FROM gold.dim_date', true), ('SELECT year FROM gold.dim_date UNION SELECT month FROM gold.dim_date', true), ('SELECT key FROM vault', false), ('DELETE FROM gold.dim_date', false),
      ('SELECT year FROM gold.dim_date; SELECT 2', false), ('SHOW DATABASES', false), ('SELECT java_method(year) FROM gold.dim_date', false), ('SELECT year FROM gold.dim_date EXCEPT SELECT month FROM gold.dim_date', false)) t("statement", admitted)""",
    "g8_lint": """SELECT * FROM (VALUES ('f.train_no > 5', true), ('f.date_key = DATE ''2026-06-02''', false), ('f.date_key >= DATE ''2026-06-02'' AND f.train_no > 5', false), ('f.date_key >= DATE ''2026-06-02'' OR f.train_no > 5', true),
      ('f.date_key IN (DATE ''2026-06-02'', DATE ''2026-06-09'')', false), ('f.date_key = f.loaded_at', true), ('f.date_key < (SELECT max(date_key) FROM gold.dim_date)', true), ('month(f.date_key) = 6', true)) t("condition", flagged)""",
    "l4_row_cap": "SELECT own_limit, least(n, cap) AS rows FROM (VALUES ('', 20), ('LIMIT 7', 7), ('LIMIT 1000', 20)) t(own_limit, cap), (SELECT count(*) AS n FROM dim_relation)",
    "e1_compared": "SELECT * FROM (VALUES ('itself', true), ('as_set_in_percent', true), ('as_set_without_percent', false), ('in_another_order', false), ('another_ranking', false), ('first_row_only', true)) t(case_name, agrees)",
    "e3_hits": _HITS + "SELECT * FROM hits",
    "t7_flat_headings": f"SELECT lower({_flat('heading')}) AS shape, count(*) AS rows FROM kb_chunk WHERE heading IS NOT NULL GROUP BY 1",
    "t10_route": f"""WITH m AS (SELECT item_id, item_text, {_COUNTED.format(_ASKS_DATA)} AS data, {_COUNTED.format(_ASKS_CONCEPT)} AS concept FROM eval_item),
      n AS (SELECT *, data + CASE WHEN regexp_matches(item_text, '\\b(19|20)[0-9]{{2}}\\b') THEN 1 ELSE 0 END AS dated FROM m)
      SELECT item_id, CAST(data AS INTEGER) AS data, CAST(concept AS INTEGER) AS concept, CASE WHEN dated > 0 AND concept = 0 THEN 'data' WHEN concept > 0 AND dated = 0 THEN 'conceptual' END AS route FROM n""",
    "d4_running_lines": rf"""WITH l AS (SELECT doc_id, chunk_index, unnest(string_split(content, chr(10))) AS line FROM kb_chunk), t AS (SELECT doc_id, count(DISTINCT chunk_index) AS total FROM l GROUP BY 1),
      s AS (SELECT doc_id, regexp_replace({_flat('line')}, '\p{{Nd}}+', '#', 'g') AS shape, count(DISTINCT chunk_index) AS pages FROM l GROUP BY 1, 2) SELECT doc_id, shape, pages FROM s JOIN t USING (doc_id) WHERE shape <> '' AND pages >= greatest(2, floor(total * 0.5))""",
    "s2_contract_violations": _violations(),
    "s3_typed_readers": " UNION ALL ".join(f"SELECT '{t.name}' AS table_name, {len(t.columns)} AS columns, count(*) AS rows FROM {t.name}" for t in (DIM_DATE, DIM_STATION, DIM_RELATION, FACT)),
    "s7_range_scan": "SELECT date_key, station_key, train_no, delay_arr_s FROM fact_stop_event WHERE date_key >= DATE '2026-08-01' AND date_key < DATE '2026-08-04'",
    "s8_count_in_range": f"SELECT count(*) AS rows FROM fact_stop_event WHERE {JULY}",
    "s19_last_line_wins": """SELECT station_key, snapshot_no, station_name, station_type FROM (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY snapshot_no DESC, loaded_at DESC, station_name DESC NULLS LAST, station_type DESC NULLS LAST) AS r
      FROM dim_station_snapshot) WHERE r = 1""",
    "f1_open_scopes": """SELECT count(*) FILTER (WHERE date_key >= DATE '2026-08-01') AS "from", count(*) FILTER (WHERE date_key < DATE '2026-06-15') AS until, count(*) AS "all" FROM fact_stop_event""",
    "f2_null_keys": f"SELECT stg_id FROM stg_fact_stop_event WHERE {NULL_KEY}",
    "f3_valid_rows": FLAGS + f"SELECT stg_id FROM flags WHERE {VALID}",
    "f4_measured_derived": "SELECT CAST(CASE WHEN punctual_arrivals IS NULL THEN 0 ELSE 1 END AS SMALLINT) AS measured_arrivals, punctual_arrivals, count(*) AS rows FROM fact_stop_event GROUP BY ALL",
    "f5_literal_range": f"SELECT CAST(sum(stop_events) AS BIGINT) AS stop_events, min(date_key) AS first_day, max(date_key) AS last_day FROM fact_stop_event WHERE {JULY}",
    "f6_named_station": "SELECT station_name, count(*) AS stations, min(station_key) AS first_key FROM dim_station WHERE station_key <> -1 AND station_type = 'Station' GROUP BY 1 HAVING count(*) > 1",
    "f7_distinct_from": "SELECT planned_hour, count(*) AS rows FROM fact_stop_event WHERE delay_arr_s IS DISTINCT FROM delay_dep_s GROUP BY 1",
    "f8_positions_absent": "SELECT doc_id, chunk_index FROM kb_chunk k WHERE NOT EXISTS (SELECT 1 FROM kb_chunk x WHERE x.chunk_index < 3 AND x.doc_id = k.doc_id AND x.chunk_index = k.chunk_index)",
    "f9_excluded_before_limit": f"SELECT query_id, vec_id, label, round(s, 6) AS similarity FROM {_near_set(10, 'e.label NOT IN (0, 1)')}",
    "f10_floor_after_top": f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM {_near_set(20)} WHERE s >= 0.3",
    "f11_coverage_tests": "SELECT min(date_key) <= DATE '2026-07-15' AND max(date_key) >= DATE '2026-07-15' AS covers_july, min(date_key) <= DATE '2019-03-01' AND max(date_key) >= DATE '2019-03-01' AS covers_2019, min(date_key) <= DATE '2026-12-31' AND max(date_key) >= DATE '2026-08-01' AS overlaps_autumn FROM fact_stop_event",
    "j1_station_rate": f"SELECT station_name, CAST(sum(punctual_arrivals) AS BIGINT) AS punctual, CAST(sum(measured_arrivals) AS BIGINT) AS measured, {RATE} AS rate FROM fact_stop_event JOIN dim_station USING (station_key) WHERE {JULY} GROUP BY 1",
    "j2_relation_rate": f"SELECT relation, CAST(sum(measured_arrivals) AS BIGINT) AS measured, {RATE} AS rate FROM fact_stop_event JOIN dim_relation USING (relation_key) WHERE {JULY} GROUP BY 1",
    "j3_weekend_by_calendar": f"SELECT month, CAST(sum(stop_events) AS BIGINT) AS stop_events, {RATE} AS rate FROM fact_stop_event JOIN dim_date USING (date_key) WHERE is_weekend GROUP BY 1",
    "j4_star": f"SELECT station_type, operator, day_name, CAST(sum(stop_events) AS BIGINT) AS stop_events, {RATE} AS rate FROM fact_stop_event JOIN dim_station USING (station_key) JOIN dim_relation USING (relation_key) JOIN dim_date USING (date_key) GROUP BY ALL",
    "j5_station_activity": "SELECT s.station_key, CAST(coalesce(sum(f.stop_events), 0) AS BIGINT) AS observed_stop_events FROM dim_station s LEFT JOIN fact_stop_event f USING (station_key) GROUP BY 1",
    "j7_orphan_stations": "SELECT stg_id, station_key FROM stg_fact_stop_event s WHERE station_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_station x WHERE x.station_key = s.station_key)",
    "j8_orphans_once": FLAGS + "SELECT count(*) AS orphan_rows FROM flags WHERE orphan_date OR orphan_station OR orphan_relation",
    "j9_repeated_grain": FLAGS + "SELECT stg_id FROM flags WHERE duplicate_grain",
    "j10_constant_join": "SELECT planned_hour, CAST(sum(stop_events) AS BIGINT) AS stop_events, CAST(sum(stop_events) AS DOUBLE) / any_value(total) AS share FROM fact_stop_event JOIN (SELECT CAST(sum(stop_events) AS BIGINT) AS total FROM fact_stop_event) ON 1 = 1 GROUP BY 1",
    "j12_subqueries": "SELECT station_key, CAST(sum(stop_events) AS BIGINT) AS events FROM fact_stop_event WHERE relation_key IN (SELECT relation_key FROM dim_relation WHERE operator = 'NVR') AND date_key > (SELECT min(date_key) FROM fact_stop_event) GROUP BY 1",
    "q1_rule_counts": FLAGS + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS rows_failed FROM flags" for r in RULES),
    "q6_rule_samples": FLAGS
    + ", keyed2 AS (SELECT *, "
    + " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in KEYS)
    + " AS key FROM flags) "
    + " UNION ALL ".join(f"(SELECT key, '{r}' AS rule FROM keyed2 WHERE {r} ORDER BY key LIMIT 5)" for r in RULES),
    "q8_integrity": "SELECT count(*) AS orphan_rows FROM fact_stop_event f WHERE NOT EXISTS (SELECT 1 FROM dim_date x WHERE x.date_key = f.date_key) OR NOT EXISTS (SELECT 1 FROM dim_station x WHERE x.station_key = f.station_key) OR NOT EXISTS (SELECT 1 FROM dim_relation x WHERE x.relation_key = f.relation_key)",
    "q10_dimension_counts": "SELECT * FROM (SELECT 'dim_date' AS table_name, 10227 AS claimed, count(*) AS found FROM dim_date UNION ALL SELECT 'dim_station', 4000, count(*) FROM dim_station UNION ALL SELECT 'dim_relation', 300, count(*) FROM dim_relation) WHERE claimed <> found",
    "q12_freshness": """SELECT fact_last, fact_events, fact_rows, rollup_last, rollup_events, rollup_rows, fact_rows = 0 OR (fact_last IS NOT DISTINCT FROM rollup_last AND fact_events IS NOT DISTINCT FROM rollup_events AND fact_rows = rollup_rows) AS is_fresh
      FROM (SELECT max(date_key) AS fact_last, CAST(sum(stop_events) AS BIGINT) AS fact_events, count(*) AS fact_rows FROM fact_stop_event), (SELECT max(date_key) AS rollup_last, CAST(sum(stop_events) AS BIGINT) AS rollup_events, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rollup_rows FROM agg_station_day)""",
    "a1_rate": f"SELECT {RATE} AS rate FROM fact_stop_event WHERE {JULY}",
    "a2_full_period": f"SELECT {RATE} AS rate, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM fact_stop_event",
    "a3_worst_stations": _ranking("dim_station", "station_key", "station_name", "ASC", 5),
    "a3_best_stations": _ranking("dim_station", "station_key", "station_name", "DESC", 3),
    "a3_worst_relations": _ranking("dim_relation", "relation_key", "relation", "ASC", 5),
    "a4_by_month": f"SELECT EXTRACT(MONTH FROM date_key) AS month, {RATE} AS rate, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM fact_stop_event GROUP BY EXTRACT(MONTH FROM date_key)",
    "a5_daily_series": f"SELECT date_key, {RATE} AS rate, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM fact_stop_event WHERE station_key = (SELECT station_key FROM agg_station_day WHERE station_key <> -1 GROUP BY 1 ORDER BY sum(stop_events) DESC, 1 LIMIT 1) GROUP BY 1",
    "a6_station_rollup": f"SELECT date_key, station_key, {SUMS} FROM fact_stop_event GROUP BY ALL",
    "a6_relation_rollup": f"SELECT date_key, relation_key, {SUMS} FROM fact_stop_event GROUP BY ALL",
    "a7_rollup_difference": f"""WITH b AS (SELECT date_key, station_key, {SUMS} FROM fact_stop_event GROUP BY ALL), k AS (SELECT date_key, station_key, row_count, stop_events, measured_arrivals, punctual_arrivals FROM agg_station_day)
      SELECT *, 'fact' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM k) UNION ALL SELECT *, 'rollup' FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM b)""",
    "a8_rollup_by_month": "SELECT EXTRACT(MONTH FROM date_key) AS month, station_key, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(stop_events) AS BIGINT) AS stop_events, CAST(sum(measured_arrivals) AS BIGINT) AS measured_arrivals, CAST(sum(punctual_arrivals) AS BIGINT) AS punctual_arrivals FROM agg_station_day GROUP BY 1, 2",
    "a9_profile": "SELECT count(*) AS fact_rows, min(date_key) AS first_day, max(date_key) AS last_day, count(DISTINCT date_key) AS days, count(DISTINCT station_key) AS stations FROM fact_stop_event",
    "a10_calendar": "SELECT min(date_key) AS first_day, max(date_key) AS last_day FROM dim_date",
    "a11_fact_window": "SELECT min(date_key) AS first_day, max(date_key) AS last_day FROM fact_stop_event",
    "a12_trains": "SELECT date_key, count(DISTINCT train_no) AS trains FROM fact_stop_event GROUP BY 1",
    "a14_latest_load": "SELECT max(load_no) AS load_no, max(CAST(loaded_at AS DATE)) AS landed_on FROM stg_fact_stop_event",
    "a15_store_counts": "SELECT count(*) AS chunks, count(content_hash) AS hashed, count(*) - count(content_hash) AS pending FROM kb_chunk",
    "a16_rows_per_year": "SELECT EXTRACT(YEAR FROM date_key) AS year, count(*) AS rows FROM fact_stop_event GROUP BY 1",
    "a17_percentiles": f"SELECT route, round(quantile_cont(total_ms, 0.5), 6) AS p50, round(quantile_cont(total_ms, 0.95), 6) AS p95, count(*) AS requests FROM {REQUESTS} WHERE total_ms IS NOT NULL AND NOT isnan(total_ms) GROUP BY 1",
    "a18_report": f"SELECT kind, count(*) AS requests, count(*) FILTER (WHERE error_class IS NULL) AS succeeded, CAST(count(*) FILTER (WHERE error_class IS NULL) AS DOUBLE) / count(*) AS success_rate FROM {REQUESTS} GROUP BY 1",
    "a18_spans": f"SELECT s.name AS name, round(quantile_cont(s.duration_ms, 0.5), 6) AS p50, round(quantile_cont(s.duration_ms, 0.95), 6) AS p95, count(*) AS spans FROM (SELECT unnest(spans) AS s FROM {REQUESTS}) WHERE s.duration_ms IS NOT NULL AND NOT isnan(s.duration_ms) GROUP BY 1",
    "a18_errors": f"SELECT error_class, error_span, count(*) AS requests FROM {REQUESTS} WHERE error_class IS NOT NULL GROUP BY 1, 2",
    "l1_busiest_days": "SELECT date_key, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM agg_station_day GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "l2_active_stations": "SELECT station_key, station_name, observed_stop_events FROM dim_station WHERE station_key <> -1 AND station_name IS NOT NULL ORDER BY observed_stop_events DESC NULLS LAST, station_key LIMIT 12",
    "l3_operators": "SELECT DISTINCT operator FROM dim_relation WHERE operator IS NOT NULL ORDER BY 1 LIMIT 12",
    "l6_nearest": f"SELECT query_id, vec_id, label, round(s, 6) AS similarity FROM {_near_set(5)}",
    "l8_pending_chunks": "SELECT doc_id, chunk_index, length(content) AS chars FROM kb_chunk WHERE content_hash IS NULL",
    "u1_union": "SELECT station_key FROM fact_stop_event UNION SELECT station_key FROM stg_fact_stop_event",
    "u1_union_all": "SELECT kind, label, count(*) AS rows FROM (SELECT 'station' AS kind, station_type AS label FROM dim_station UNION ALL SELECT 'relation', operator FROM dim_relation) GROUP BY 1, 2",
    "u2_multiset_difference": "SELECT station_key, planned_hour, count(*) AS rows FROM (SELECT station_key, planned_hour FROM stg_fact_stop_event EXCEPT ALL SELECT station_key, planned_hour FROM fact_stop_event) GROUP BY 1, 2",
    "w1_upsert": _ENDS + "SELECT station_key, v.n AS station_name, v.t AS station_type, outcome FROM up",
    "w1_upsert_counts": _ENDS + "SELECT outcome, count(*) AS stations FROM up GROUP BY 1",
    "w2_replace_scope": FLAGS
    + f", s AS (SELECT date_key, stop_events FROM fact_stop_event WHERE NOT (date_key >= DATE '2026-08-10' AND date_key < DATE '2026-08-20') UNION ALL SELECT date_key, stop_events FROM flags WHERE {VALID} AND date_key >= DATE '2026-08-10' AND date_key < DATE '2026-08-20') SELECT date_key, count(*) AS rows, CAST(sum(stop_events) AS BIGINT) AS stop_events FROM s GROUP BY 1",
    "w3_promote": FLAGS
    + f"SELECT date_key, CAST(CASE WHEN punctual_arrivals IS NULL THEN 0 ELSE 1 END AS SMALLINT) AS measured_arrivals, count(*) AS rows, CAST(sum(punctual_arrivals) AS BIGINT) AS punctual FROM flags WHERE {VALID} AND date_key >= DATE '2026-08-10' AND date_key < DATE '2026-08-20' GROUP BY 1, 2",
    "w5_sync": """WITH s AS (SELECT doc_id, chunk_index + CASE WHEN md5(doc_id) < '4' THEN 1 ELSE 0 END AS chunk_index, CASE WHEN chunk_index % 5 = 0 THEN 'stale' ELSE content_hash END AS h FROM kb_chunk),
      c AS (SELECT doc_id, chunk_index, sha256(concat_ws(chr(10) || chr(10), nullif(heading, ''), content)) AS h FROM kb_chunk)
      SELECT CASE WHEN c.doc_id IS NULL THEN 'deleted' WHEN s.doc_id IS NULL THEN 'inserted' WHEN s.h IS DISTINCT FROM c.h THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS positions FROM s FULL JOIN c ON s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index GROUP BY 1""",
    "w8_month_partitions": "SELECT strftime(m, 'p%Y_%m') AS partition_name, CAST(m AS DATE) AS start_day, CAST(m + INTERVAL 1 MONTH AS DATE) AS end_day FROM (SELECT unnest(generate_series(TIMESTAMP '2026-06-01', TIMESTAMP '2026-08-01', INTERVAL 1 MONTH)) AS m)",
    "w8_outside_partitions": "SELECT stg_id FROM stg_fact_stop_event WHERE date_key < DATE '2026-08-01' OR date_key >= DATE '2026-09-01' OR date_key IS NULL",
    "c6_existing_partitions": "SELECT DISTINCT strftime(date_key, 'p%Y_%m') AS partition_name FROM fact_stop_event",
    "t3_hard_split": f"SELECT doc_id, chunk_index, CAST(i AS INTEGER) AS piece_no, md5(substring(content, CAST(i * {MAX_CHARS} + 1 AS BIGINT), {MAX_CHARS})) AS piece_md5 FROM (SELECT *, unnest(range(CAST(ceil(length(content) / {MAX_CHARS}.0) AS BIGINT))) AS i FROM kb_chunk WHERE length(content) > 0)",
    "t4_merge_short": f"""WITH k AS (SELECT doc_id, chunk_index, coalesce(content, '') AS content FROM kb_chunk), b AS (SELECT *, CASE WHEN length(content) >= {MIN_CHARS} OR row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) = 1 THEN 1 ELSE 0 END AS begins FROM k),
      g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS g FROM b) SELECT doc_id, min(chunk_index) AS chunk_index, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5 FROM g GROUP BY doc_id, g""",
    "t5_content_hash": "SELECT doc_id, chunk_index, sha256(concat_ws(chr(10) || chr(10), nullif(heading, ''), content)) AS content_hash FROM kb_chunk",
    "t8_redact": rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '(://[^:/@{_BLANK}]+:)[^@/{_BLANK}]+@', '\1***@', 'g'),
      '(password|passwd|pwd|secret|token|api[_-]?key)([''"]?[{_BLANK}]*[:=][{_BLANK}]*[''"]?)[^''"{_BLANK},;]+', '\1\2***', 'gi') AS text FROM documents""",
    "t9_question_print": "SELECT item_id, left(sha256(item_text), 12) AS question_hash, CAST(length(item_text) AS INTEGER) AS question_length FROM eval_item",
    "d1_clusters": """WITH s AS (SELECT station_type, latitude AS y FROM dim_station WHERE latitude IS NOT NULL AND station_type IS NOT NULL), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY station_type ORDER BY y) > 0.01 THEN 1 ELSE 0 END AS brk FROM s),
      n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY station_type ORDER BY y) AS BIGINT) AS cluster_no FROM g) SELECT station_type, cluster_no, count(*) AS members, round(avg(y), 4) AS centre FROM n GROUP BY 1, 2""",
    "v3_two_rankings": f"SELECT query_id, 'all' AS scope, vec_id FROM {_near_set(5)} UNION ALL SELECT query_id, 'label 2', vec_id FROM {_near_set(5, 'e.label = 2')}",
    "v4_widths": "SELECT len(embedding) AS width, count(*) AS rows, len(embedding) = 64 AS fits FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "v5_pending": "SELECT label, count(*) AS rows FROM embeddings WHERE label < 5 GROUP BY 1",
    "c10_floor_shown": f"SELECT query_id, vec_id, round(s, 6) AS similarity, s >= 0.35 AS kept FROM {_near_set(12)}",
    "e8_report": _HITS + "SELECT round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, count(*) AS cases FROM hits",
}
