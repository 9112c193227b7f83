import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from quaystone.context.pipeline import AnswerPipeline, Canned, StaleRollup, Unanswered
from quaystone.context.prompts import coverage, extract_sql
from quaystone.evaluation.compare import Spec, cells_agree, compare, hit_at, reciprocal_rank
from quaystone.evaluation.runner import Case, DayBudget, ExpectedResults, Reply, ReplyCache, calls_needed, judge, markdown, report, run
from quaystone.functions.vectors import SeededEmbedder
from quaystone.plans.guard import Policy
from quaystone.streaming.incremental import append_partials, current, fact_stream


@pytest.mark.parametrize(
    "want,got,spec,agrees",
    [
        ([(0.9523,)], [("x", 0.95231)], Spec("scalar"), True),
        ([(0.9523,)], [(95.2,)], Spec("scalar", accept_percent=True), True),
        ([(0.9523,)], [(95,)], Spec("scalar", accept_percent=True), False),
        ([(0.9523,)], [(95.2,)], Spec("scalar"), False),
        ([(0.5,)], [(Decimal("0.5"),)], Spec("scalar"), True),
        ([(None,)], [(None,)], Spec("scalar"), True),
        ([("A", 1), ("B", 2)], [(1, "a ", 9), (2, "b", 9)], Spec("ordered"), True),
        ([("A", 1), ("B", 2)], [("B", 2), ("A", 1)], Spec("ordered"), False),
        ([("A", 1), ("B", 2)], [("B", 2), ("A", 1)], Spec("set"), True),
        ([("A", 1), ("B", 2)], [("B", 1), ("A", 2)], Spec("set"), False),
        ([("A",), ("B",), ("C",)], [("A",), ("B",), ("D",)], Spec("ordered", top_k=2), True),
        ([("A",)], [("A",), ("A",)], Spec("set"), False),
        ([("A", 1)], [("A",)], Spec("set"), False),
        ([], [], Spec("set"), True),
        ([], [(1,)], Spec("set"), False),
        ([(date(2026, 1, 1),)], [("2026-01-01",)], Spec("set"), True),
        ([(1.0, 1.0), (1.0, 2.0)], [(2.0, 1.0), (1.0, 1.0)], Spec("set"), True),
        ([(i % 3, i) for i in range(12)], [(i, i % 3) for i in reversed(range(12))], Spec("set"), True),
    ],
)
def test_compare(want, got, spec, agrees):
    assert compare(want, got, spec)[0] is agrees


def test_cells_and_ranks():
    assert cells_agree(True, True, Spec()) and not cells_agree("a", 1, Spec()) and cells_agree(float("nan"), float("nan"), Spec())
    assert hit_at({"a"}, ["b", "a"], 2) and not hit_at({"a"}, ["b", "a"], 1) and reciprocal_rank({"a"}, ["b", "a"]) == 0.5 and reciprocal_rank({"x"}, []) == 0.0
    with pytest.raises(ValueError):
        hit_at({"a"}, [], 0)
    with pytest.raises(ValueError):
        Spec("other")


def test_extract_sql():
    assert extract_sql("Sure:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert extract_sql("NO_SQL") is None and extract_sql("with a as (select 1) select * from a;").startswith("with")
    with pytest.raises(ValueError):
        extract_sql("I cannot")
    assert "EMPTY" in coverage({"fact_rows": 0})


def test_runner(tmp_path):
    cases = [Case("a", "q1", sql="S", spec=Spec("scalar")), Case("b", "q2", route="conceptual", sources=(("d", "h"),)), Case("c", "q3", behaviour="refused"), Case("d", "q4", behaviour="no_data"), Case("e", "q5", sql="S", known_limitation=True)]
    replies = {"q1": Reply("data", [(1,)], trace={"spans": [{"name": "execute", "duration_ms": 4.0}]}), "q2": Reply("conceptual", sources=(("x", None), ("d", "h"))), "q3": Reply("data", refused="no"), "q4": Reply("data", [(None,)])}
    out = str(tmp_path / "r.jsonl")
    results = run(cases, lambda q: replies[q], lambda sql: [(1,)], out)
    assert [r["passed"] for r in results] == [True, True, True, True, False] and results[4]["reason"] == "KeyError"
    again = run(cases, lambda q: 1 / 0, lambda sql: [], out)
    assert [r["passed"] for r in again] == [True, True, True, True, False]
    summary = report(results)
    assert summary["sql"] == {"passed": 1, "of": 1} and summary["mrr"] == 0.5 and summary["spans_ms"] == {"execute": {"n": 1, "p50": 4.0, "p95": 4.0}} and not summary["incomplete"] and "| sql | 1 | 1 |" in markdown(summary)
    assert report(results, ["a", "z"])["incomplete"] and "incomplete" in markdown(report(results, ["z"]))
    traced = [{**results[0], "trace": {"findings": f, "partitions": {"t": n}, "spans": [{"name": "execute", "duration_ms": ms, "provider_calls": [{"prompt": 5, "retries": 1}]}]}} for f, n, ms in ((["x"], 3, 1.0), ([], 1, 2.0), ([], 2, 10.0))]
    whole = report(traced)
    assert whole["lint"] == {"passed": 2, "of": 3} and whole["partitions"] == 2 and whole["tokens"]["prompt"] == 15 and whole["retries"] == 3
    assert whole["spans_ms"]["execute"] == {"n": 3, "p50": 2.0, "p95": 9.2} and "| execute | 3 | 2.0 | 9.2 |" in markdown(whole)
    assert calls_needed(cases, ["a"]) == 1 + 3 + 3 + 3 and calls_needed(cases, [c.id for c in cases]) == 0 and calls_needed(cases[:1], [], lambda q: True) == 4
    assert not judge(cases[0], Reply("data", refused="x"), [(1,)])[0]
    with pytest.raises(ValueError):
        Case("x", "q", sql="S", behaviour="refused")


def test_reply_cache(tmp_path):
    waits = []
    cache = ReplyCache(str(tmp_path / "c.json"), str.upper, per_minute=4, budget=DayBudget(str(tmp_path / "b.json"), 2), clock=lambda: 0.0, sleep=waits.append)
    assert [cache("a"), cache("a"), cache("b")] == ["A", "A", "B"] and waits == [15.0] and cache.hits == 1
    with pytest.raises(RuntimeError):
        cache("c")
    # The budget outlives the run, and ends with the day.
    day = [datetime(2026, 3, 1, 23, 59)]
    budget = DayBudget(str(tmp_path / "d.json"), 1, lambda: day[0])
    budget.spend()
    assert budget.left() == DayBudget(str(tmp_path / "d.json"), 1, lambda: day[0]).left() == 0
    day[0] = datetime(2026, 3, 2, 0, 1)
    assert budget.left() == 1
    assert ReplyCache(str(tmp_path / "c.json"), lambda p: 1 / 0)("b") == "B"


def test_expected_results_are_whole_or_refused(spark, tmp_path):
    path = str(tmp_path / "held.json")
    assert len(ExpectedResults(spark, path, "s").of("SELECT id FROM range(12000)")) == 12000
    assert ExpectedResults(spark, path, "s").of("SELECT id FROM range(12000)")[-1] == (11999,)
    with pytest.raises(ValueError, match="more than 5 rows"):
        ExpectedResults(spark, path, "s", most_rows=5).of("SELECT id FROM range(6)")


@pytest.fixture(scope="module")
def lake(spark, sf):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    for n in ("dim_date", "dim_station", "dim_relation", "fact_stop_event", "agg_station_day"):
        spark.sql(f"DROP TABLE IF EXISTS lake.{n}")
        spark.sql(f"CREATE TABLE lake.{n} USING parquet LOCATION '{sf}/{n}.parquet'")
    yield spark
    spark.sql("DROP DATABASE lake CASCADE")


POLICY = Policy(frozenset(f"lake.{n}" for n in ("dim_date", "dim_station", "fact_stop_event", "agg_station_day")), max_rows=5, default_schema="lake")


def test_pipeline(lake):
    sql = "SELECT COUNT(*) AS n FROM lake.fact_stop_event"
    p = AnswerPipeline(lake, POLICY, Canned(["DROP TABLE x_not_sql", f"```sql\nDELETE FROM lake.dim_date\n```", "It is 4000."]))
    assert p.ready() is None and "COVERAGE: 4000 rows" in p.system
    with pytest.raises(Unanswered):
        p.answer("How many rows in total?")
    p.generate = Canned(["SELECT * FROM lake.secret", sql, "It is 4000."])
    got = p.answer("How many rows in total?")
    assert got.result.rows == [(4000,)] and got.text == "It is 4000." and got.findings == ("fact_without_partition_filter",) and "secret" in p.generate.prompts[1]
    p.generate = Canned(["SELECT nope FROM lake.dim_date"])
    with pytest.raises(Unanswered, match="AnalysisException"):
        p.answer("How many rows in total?", narrate=False)
    with pytest.raises(Unanswered):
        p.answer(" ")
    p.generate = Canned([sql, "It is 4000."])
    status, body = p.ask({"question": "How many rows in total?"})
    assert status == 200 and body["rows"] == [[4000]] and body["columns"] == ["n"] and body["findings"] and p.health() == {"status": "ok"}
    assert [p.ask(b)[0] for b in ({}, {"question": ""}, {"question": "x" * 501}, {"question": "x", "more": 1}, [], {"question": 5})] == [400] * 6
    p.generate = Canned(["DROP TABLE x", "DELETE FROM lake.dim_date"])
    assert p.ask({"question": "How many rows in total?"})[0] == 422
    p.generate = Canned([])
    assert p.ask({"question": "How many rows in total?"}) == (503, {"detail": "IndexError"})


def test_pipeline_passages_and_stale_rollup(lake):
    e = SeededEmbedder(8)
    texts = ["The threshold is six minutes.", "Other"]
    chunks = lake.createDataFrame([("d", i, "H", t, v) for i, (t, v) in enumerate(zip(texts, e.embed(texts)))], "doc_id string, chunk_index int, heading string, content string, embedding array<double>")
    p = AnswerPipeline(lake, POLICY, Canned(["Six minutes."]), chunks, e, top_k=1)
    got = p.answer("What does punctual mean and why is it so?")
    assert got.route == "conceptual" and got.text == "Six minutes." and len(got.sources) == 1
    lake.table("lake.agg_station_day").limit(10).write.saveAsTable("lake.agg_relation_day")
    with pytest.raises(StaleRollup):
        AnswerPipeline(lake, Policy(POLICY.tables | {"lake.agg_relation_day"}, default_schema="lake"), Canned([]))


def test_streaming_rollup(spark, sf, tmp_path):
    fact = spark.read.parquet(f"{sf}/fact_stop_event.parquet").drop("loaded_at")
    for part in range(2):
        fact.where(f"train_no % 2 = {part}").write.parquet(str(tmp_path / f"in/p{part}"))
    src, out, cp = str(tmp_path / "in/*"), str(tmp_path / "out"), str(tmp_path / "cp")
    append_partials(fact_stream(spark, src), "station_key", out, cp).awaitTermination()
    append_partials(fact_stream(spark, src), "station_key", out, cp).awaitTermination()
    kept = spark.read.parquet(f"{sf}/agg_station_day.parquet").select("date_key", "station_key", "row_count", "stop_events", "measured_arrivals", "punctual_arrivals")
    now = current(spark, out, "station_key").select(*kept.columns)
    assert now.exceptAll(kept).count() == 0 and kept.exceptAll(now).count() == 0


def test_trace_lines(tmp_path):
    from quaystone.evaluation.trace import sink, span, traced

    path = str(tmp_path / "t.jsonl")
    sink(path)
    with pytest.raises(KeyError), traced("answer", "secret question"), span("outer"), span("inner"):
        raise KeyError("x")
    line = json.loads(open(path).read())
    assert line["error_class"] == "KeyError" and line["error_span"] == "inner" and [s["name"] for s in line["spans"]] == ["inner", "outer"] and "secret" not in json.dumps(line)
