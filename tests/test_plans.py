"""The guard and the lint over a small harbour of their own: berths, and visits kept by day."""

import itertools
import time

import pytest

from quaystone.plans.execute import QueryFailed, QueryTooExpensive, check_cost, estimate, execute
from quaystone.plans.guard import ALLOWED_NODES, ROOTS_REFUSED, Policy, UnsafeQuery, analysed, capped, parse, plan_nodes, validate
from quaystone.plans.lint import FACT_WITHOUT_PARTITION_FILTER, lint

HARBOUR = Policy(frozenset({"harbour.berth", "harbour.visit"}), max_rows=6, timeout_s=20, default_schema="harbour")
KEYS = {"berth": ("", frozenset({"berth_id", "quay", "depth"})), "visit": ("day", frozenset({"day", "berth_id", "hours"}))}


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("harbour")
    spark.sql("CREATE DATABASE IF NOT EXISTS harbour")
    spark.range(9).selectExpr("CAST(id AS int) AS berth_id", "concat('q', id % 2) AS quay", "id * 1.5 AS depth").write.parquet(str(folder / "berth"))
    spark.range(120).selectExpr("date_add(DATE '2031-03-01', CAST(id % 12 AS int)) AS day", "CAST(id % 9 AS int) AS berth_id", "CAST(id % 30 AS int) AS hours").write.partitionBy("day").parquet(str(folder / "visit"))
    spark.sql(f"CREATE TABLE harbour.berth USING parquet LOCATION '{folder}/berth'")
    spark.catalog.createTable("harbour.visit", str(folder / "visit"), "parquet")
    spark.catalog.recoverPartitions("harbour.visit")
    yield spark
    spark.sql("DROP DATABASE harbour CASCADE")


# --- the guard ---


def _nests(inner: str) -> dict[str, str]:
    """A query in every place where a query may stand."""
    return {
        "alone": inner,
        "derived": f"SELECT * FROM ({inner}) d",
        "scalar": f"SELECT ({inner} LIMIT 1) AS v",
        "filter": f"SELECT quay FROM berth WHERE berth_id IN ({inner})",
        "exists": f"SELECT quay FROM berth WHERE EXISTS ({inner})",
        "named": f"WITH d AS ({inner}) SELECT * FROM d",
        "named_twice": f"WITH c AS ({inner}), d AS (SELECT * FROM c) SELECT * FROM d",
        "branch": f"SELECT berth_id FROM visit UNION ALL {inner}",
        "condition": f"SELECT b.quay FROM berth b JOIN visit v ON v.berth_id = b.berth_id AND v.berth_id IN ({inner})",
        "ordering": f"SELECT quay FROM berth ORDER BY ({inner} LIMIT 1)",
    }


PLACES = sorted(_nests("x"))


@pytest.mark.parametrize("place", PLACES)
def test_admitted_in_every_place(harbour, place):
    got = validate(harbour, _nests("SELECT berth_id FROM visit")[place], HARBOUR)
    assert "harbour.visit" in got.tables and got.tables <= HARBOUR.tables and got.limit == 6


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("inner", ["SELECT berth_id FROM ledger", "SELECT berth_id FROM other.visit", "SELECT berth_id FROM csv.`/tmp/x`", "SELECT id FROM range(3)"])
def test_foreign_relations_are_refused_in_every_place(harbour, place, inner):
    with pytest.raises(UnsafeQuery):
        validate(harbour, _nests(inner)[place], HARBOUR)


@pytest.mark.parametrize("name", sorted(HARBOUR.blocked_functions))
def test_blocked_functions_are_refused_in_every_place(harbour, name):
    for place in PLACES:
        with pytest.raises(UnsafeQuery):
            validate(harbour, _nests(f"SELECT {name}(berth_id) FROM visit")[place], HARBOUR)
        with pytest.raises(UnsafeQuery):
            validate(harbour, _nests(f"SELECT {name} FROM visit")[place], HARBOUR)


def test_a_policy_blocks_what_it_lists(harbour):
    asked = "SELECT upper(quay) FROM berth"
    assert validate(harbour, asked, HARBOUR).tables == {"harbour.berth"}
    with pytest.raises(UnsafeQuery, match="upper"):
        validate(harbour, asked, Policy(HARBOUR.tables, default_schema="harbour", blocked_functions=frozenset({"upper"})))
    with pytest.raises(UnsafeQuery, match="unknown"):
        validate(harbour, "SELECT no_such_function_here(quay) FROM berth", HARBOUR)


#: One statement for each kind of plan that is no query; the classes are what Spark's parser makes of them.
STATEMENTS = {
    "insert": "INSERT INTO berth SELECT * FROM berth", "overwrite": "INSERT OVERWRITE berth SELECT * FROM berth", "update": "UPDATE berth SET depth = 0", "delete": "DELETE FROM visit WHERE hours = 1", "create": "CREATE TABLE copy AS SELECT * FROM berth",
    "replace": "CREATE OR REPLACE TEMPORARY VIEW w AS SELECT 1", "drop": "DROP TABLE berth", "drop_view": "DROP VIEW w", "truncate": "TRUNCATE TABLE visit", "alter": "ALTER TABLE berth ADD COLUMNS (note string)", "comment": "COMMENT ON TABLE berth IS 'x'",
    "cache": "CACHE TABLE berth", "uncache": "UNCACHE TABLE berth", "refresh": "REFRESH TABLE berth", "analyze": "ANALYZE TABLE berth COMPUTE STATISTICS", "describe": "DESCRIBE TABLE berth", "show": "SHOW TABLES", "explain": "EXPLAIN SELECT 1",
    "set": "SET spark.x = 1", "reset": "RESET", "use": "USE harbour", "add": "ADD JAR '/tmp/x.jar'", "load": "LOAD DATA INPATH '/tmp/x' INTO TABLE berth", "immediate": "EXECUTE IMMEDIATE 'SELECT 1'",
    "merge": "MERGE INTO berth a USING visit b ON a.berth_id = b.berth_id WHEN NOT MATCHED THEN INSERT *", "values": "VALUES (1), (2)", "multi_insert": "FROM berth INSERT INTO visit SELECT *",
}


@pytest.mark.parametrize("kind", sorted(STATEMENTS))
def test_statements_that_are_no_query(harbour, kind):
    with pytest.raises(UnsafeQuery):
        validate(harbour, STATEMENTS[kind], HARBOUR)
    roots = {n.getClass().getSimpleName() for n in plan_nodes(parse(harbour, STATEMENTS[kind]))}
    assert not roots <= ALLOWED_NODES or roots & ROOTS_REFUSED


@pytest.mark.parametrize("first,second", list(itertools.permutations(["SELECT quay FROM berth", STATEMENTS["drop"], STATEMENTS["set"]], 2)))
def test_one_statement_only(harbour, first, second):
    for joint in (";", " ;\n", "; -- then\n", ";/* then */"):
        with pytest.raises(UnsafeQuery):
            validate(harbour, first + joint + second, HARBOUR)


@pytest.mark.parametrize("text", ["", " \n", ";", "quay", "SELECT quay berth WHERE", "SELECT (quay FROM berth"])
def test_what_does_not_parse(harbour, text):
    with pytest.raises(UnsafeQuery):
        validate(harbour, text, HARBOUR)


@pytest.mark.parametrize("verb", ["EXCEPT", "INTERSECT", "EXCEPT ALL", "MINUS"])
def test_difference_is_no_root_but_may_stand_inside(harbour, verb):
    both = f"SELECT berth_id FROM berth {verb} SELECT berth_id FROM visit"
    with pytest.raises(UnsafeQuery):
        validate(harbour, both, HARBOUR)
    assert validate(harbour, f"SELECT count(*) FROM ({both}) d", HARBOUR).tables == HARBOUR.tables


def test_shapes_that_analysts_write(harbour):
    for text in (
        "SELECT quay, sum(hours)::double / nullif(count(hours), 0) AS mean FROM visit JOIN berth USING (berth_id) GROUP BY quay HAVING count(*) > 1 ORDER BY mean DESC NULLS LAST, quay LIMIT 3",
        "SELECT day, hours, rank() OVER (PARTITION BY day ORDER BY hours DESC) AS place FROM visit",
        "SELECT CASE WHEN hours > 9 THEN 'long' ELSE 'short' END AS kind, EXTRACT(DAY FROM day) AS d FROM visit;",
        "SELECT quay FROM berth b LEFT JOIN LATERAL (SELECT max(hours) AS h FROM visit v WHERE v.berth_id = b.berth_id) x",
    ):
        assert validate(harbour, text, HARBOUR).tables <= HARBOUR.tables
        assert capped(harbour, validate(harbour, text, HARBOUR)).count() <= 6


@pytest.mark.parametrize("own", [None, 0, 1, 5, 6, 7, 500])
def test_the_cap_and_the_querys_own_limit(harbour, own):
    q = validate(harbour, "SELECT * FROM visit" + ("" if own is None else f" LIMIT {own}"), HARBOUR)
    rows = min(6, 120 if own is None else own)
    got = execute(harbour, q, HARBOUR)
    assert len(got.rows) == capped(harbour, q).count() == rows and got.truncated == (rows == 6) and set(got.columns) == {"day", "berth_id", "hours"}


# --- the lint ---

#: Conditions on the key of one scan: do constants bound it?
ATOMS = {"day = DATE '2031-03-02'": True, "day >= '2031-03-02'": True, "DATE '2031-03-09' > day": True, "day BETWEEN DATE '2031-03-02' AND DATE '2031-03-04'": True, "day IN (DATE '2031-03-02', CAST('2031-03-05' AS DATE))": True, "hours > 3": False, "day = date_add(day, hours)": False, "day <> DATE '2031-03-02'": False, "day > (SELECT max(day) FROM visit WHERE day < DATE '2031-03-03')": False}


def _flagged(spark, text):
    return lint(spark, text, KEYS) == (FACT_WITHOUT_PARTITION_FILTER,)


@pytest.mark.parametrize("a,b", list(itertools.combinations_with_replacement(sorted(ATOMS), 2)))
def test_and_needs_one_bound_or_needs_both(harbour, a, b):
    assert _flagged(harbour, f"SELECT 1 FROM visit WHERE {a} AND {b}") == (not (ATOMS[a] or ATOMS[b]))
    assert _flagged(harbour, f"SELECT 1 FROM visit WHERE {a} OR {b}") == (not (ATOMS[a] and ATOMS[b]))


@pytest.mark.parametrize("condition", sorted(ATOMS))
def test_every_scan_of_the_fact_counts(harbour, condition):
    bounded, free = ATOMS[condition], "SELECT berth_id FROM visit"
    scan = f"SELECT berth_id FROM visit WHERE {condition}"
    for place, text in _nests(scan).items():
        if place in ("branch", "condition"):
            assert _flagged(harbour, text)  # the other scan of it has no bound
        else:
            assert _flagged(harbour, text) == (not bounded), place
    assert _flagged(harbour, f"{scan} UNION ALL {free}") and _flagged(harbour, f"{free} UNION {scan}")


def test_bounds_stand_where_the_scan_stands(harbour):
    day = "DATE '2031-03-02'"
    assert _flagged(harbour, f"SELECT 1 FROM (SELECT day FROM visit) d WHERE d.day = {day}")
    assert not _flagged(harbour, f"SELECT 1 FROM berth b JOIN visit v ON v.berth_id = b.berth_id AND v.day = {day}")
    assert not _flagged(harbour, f"SELECT 1 FROM berth JOIN visit USING (berth_id) WHERE day = {day}")  # only one of them has a day
    assert _flagged(harbour, f"SELECT 1 FROM visit v JOIN visit w ON v.day = w.day WHERE v.day = {day}")  # equality passes no bound on
    assert _flagged(harbour, f"SELECT 1 FROM visit v JOIN visit w ON v.berth_id = w.berth_id WHERE day = {day}")  # whose day?
    assert not _flagged(harbour, "SELECT quay FROM berth WHERE depth > 2")


# --- cost and time ---


def test_estimates_and_ceiling(harbour):
    every, some = (analysed(harbour, validate(harbour, text, HARBOUR)) for text in ("SELECT sum(hours) FROM visit", "SELECT sum(hours) FROM visit JOIN berth USING (berth_id) WHERE day < DATE '2031-03-04'"))
    assert estimate(every).scan_bytes > 0 and estimate(every).partitions == {"visit": 12} and not estimate(every).partitions_pruned
    assert estimate(some).partitions == {"visit": 3, "berth": 1} and estimate(some).partitions_pruned
    assert check_cost(every, HARBOUR).files >= 12
    with pytest.raises(QueryTooExpensive):
        check_cost(every, Policy(HARBOUR.tables, max_scan_bytes=1))


def test_failures_tell_their_kind_only(harbour):
    slow = validate(harbour, "SELECT count(*) FROM visit a, visit b, visit c, visit d, visit e WHERE a.hours + b.hours + c.hours + d.hours + e.hours > 0", HARBOUR)
    began = time.monotonic()
    with pytest.raises(QueryFailed, match="^Timeout$"):
        execute(harbour, slow, Policy(HARBOUR.tables, timeout_s=2))
    assert time.monotonic() - began < 15
    with pytest.raises(QueryFailed, match="^AnalysisException$"):
        execute(harbour, validate(harbour, "SELECT draught FROM berth", HARBOUR), HARBOUR)
