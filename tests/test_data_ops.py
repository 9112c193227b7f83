import math
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaystone.functions.hashing import bloom_bits, build_bloom, might_contain
from quaystone.operators.heavy import heavy_counts, heavy_hitters, per_key, per_keys, skew_join
from quaystone.operators.orphans import Reference, orphan_counts, orphan_references
from quaystone.operators.profile import Rule, ValueCountStore, apply_delta, load_shift, metrics, value_counts
from quaystone.operators.ranks import exact_percentiles
from quaystone.operators.snapshots import snapshot_changes
from quaystone.operators.trailing import trailing_totals
from quaystone.session import measured_join, read_text, sizes_of, write_text

T0 = datetime(2026, 1, 1)


# --- snapshots ---


def _changes(spark, rows, schema="no int, k int, name string, kind string, at timestamp, change_kind string, pair int"):
    df = spark.createDataFrame(rows, schema)
    return sorted((r.no, r.k, r.change_kind) for r in snapshot_changes(df, "no", ["k"], ["name", "kind"], "at").collect())


def test_snapshot_changes(spark):
    x = (None, None)
    rows = [
        (1, 1, "a", "s", T0, *x), (1, 2, "b", None, T0, *x), (1, 3, "c", "s", T0, *x), (1, 4, None, "d", T0, *x),
        (3, 1, "a", "s", T0, *x), (3, 2, "b", None, T0, *x), (3, 4, "d", None, T0, *x), (3, 5, "e", "s", T0, *x), (3, 5, "e", "s", T0, *x),
        (3, 1, "old", "s", T0 - timedelta(1), *x), (4, 1, "A", "s", T0, *x), (4, 5, "e", "s", T0, *x), (4, 2, "b", "", T0, *x), (4, 4, "d", None, None, *x),
        (None, 9, "n", "s", T0, *x), (4, None, "n", "s", T0, *x),
    ]
    want = [(3, 3, "removed"), (3, 4, "changed"), (3, 5, "added"), (4, 1, "changed"), (4, 2, "changed")]
    assert _changes(spark, rows) == want
    assert _changes(spark, rows[:4]) == []
    df = spark.createDataFrame([(1, 1, "a", -5), (1, 1, "b", 3), (2, 1, "b", None), (2, 1, "a", -2_000_000_000), (3, 1, "a", 7)], "no int, k int, name string, at int")
    assert [(r.no, r.change_kind) for r in snapshot_changes(df, "no", ["k"], ["name"], "at").collect()] == [(2, "changed")]
    early = df.select("no", "k", "name", F.when(F.col("at") == 3, F.lit("9999-12-31").cast("date")).when(F.col("at") == -5, F.lit("0001-01-01").cast("date")).alias("at"))
    assert sorted((r.no, r.change_kind) for r in snapshot_changes(early.where("no < 3"), "no", ["k"], ["name"], "at").collect()) in ([], [(2, "changed")])
    with pytest.raises(TypeError):
        snapshot_changes(df, "no", ["k"], ["at"], "name")
    assert _changes(spark, []) == []


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(12), rng.choice("ab"), rng.choice(["x", None]), T0 + timedelta(minutes=i), None, None) for n in (2, 5, 6, 9) for i in range(25)]
    state = defaultdict(dict)
    for n, k, name, kind, at, *_ in rows:
        if k not in state[n] or at >= state[n][k][0]:
            state[n][k] = (at, name, kind)
    want = []
    for a, b in ((2, 5), (5, 6), (6, 9)):
        for k in sorted({*state[a], *state[b]}):
            if k not in state[a]:
                want.append((b, k, "added"))
            elif k not in state[b]:
                want.append((b, k, "removed"))
            elif state[a][k][1:] != state[b][k][1:]:
                want.append((b, k, "changed"))
    assert _changes(spark, rows) == sorted(want)


# --- orphans ---


@pytest.mark.parametrize("broadcast_bytes", [64_000_000, 0])
def test_orphans(spark, broadcast_bytes):
    child = spark.createDataFrame(
        [(1, 10, "a", T0), (2, 11, "a", T0), (3, None, "zz", T0), (4, 12, None, T0), (4, 12, None, T0), (5, 12, "b", None), (6, 13, "a", T0)] + [(100 + i, 99, "a", T0) for i in range(50)],
        "id long, k int, r string, landed timestamp",
    ).withColumn("ref_status", F.lit("clash"))
    parent = spark.createDataFrame([(10, T0 - timedelta(1)), (12, T0 + timedelta(1)), (13, None), (13, T0 + timedelta(1)), (None, T0)], "k int, since timestamp")
    names = spark.createDataFrame([("a",), ("b",)], "r string")
    refs = [Reference("k", parent, "k", "since"), Reference("r", names, "r")]
    got = sorted((r.id, r.ref_column, r.ref_value, r.ref_status) for r in orphan_references(child, ["id"], refs, "landed", broadcast_bytes=broadcast_bytes).collect())
    want = [(2, "k", "11", "missing"), (3, "r", "zz", "missing"), (4, "k", "12", "late"), (4, "k", "12", "late")] + [(100 + i, "k", "99", "missing") for i in range(50)]
    assert got == sorted(want)
    empty = orphan_references(child.limit(0), ["id"], refs, "landed", broadcast_bytes=broadcast_bytes)
    assert empty.count() == 0
    lost = orphan_references(child, ["id"], [Reference("k", parent.limit(0), "k", "since")], "landed", broadcast_bytes=broadcast_bytes)
    assert lost.count() == child.where("k IS NOT NULL").count()
    counts = orphan_counts(orphan_references(child, ["id", "landed"], refs, "landed"), ["landed"]).collect()
    assert sum(r.orphans for r in counts) == len(want)


def test_bloom_filter(spark):
    keys = spark.range(0, 3000, 3)
    bloom = build_bloom(keys, F.col("id"), 1000)
    hits = spark.range(6000).where(might_contain(bloom, F.col("id")))
    assert keys.join(hits, "id", "left_anti").count() == 0
    assert hits.count() < 1000 + 0.05 * 5000
    assert bloom_bits(10**12, 0.01) == 67_108_864
    assert spark.range(5).where(might_contain(None, F.col("id"))).count() == 0


def test_measured_join_salted_equals_broadcast(spark):
    left = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 20 END AS k")
    right = spark.range(0, 15).selectExpr("id AS kk", "id * 2 AS v")
    for how in ("inner", "left"):
        a = measured_join(left, right, "k", "kk", how, sizes_of(right)[0], F.col("id"))
        b = measured_join(left, right, "k", "kk", how, sizes_of(right)[0], F.col("id"), broadcast_bytes=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# --- trailing ---


def test_trailing_against_brute_force(spark):
    rng = random.Random(8)
    start = date(2026, 1, 5)
    rows = [(rng.choice("abc"), start + timedelta(rng.randrange(40)), rng.choice([None, 1, 2, 9]), "x") for _ in range(120)] + [(None, start, 5, "x"), ("a", None, 5, "x")]
    df = spark.createDataFrame(rows, "e string, d date, v int, has_row string")
    kept = [(e, d, v or 0) for e, d, v, _ in rows if e and d]
    first, last = min(d for _, d, _ in kept), max(d for _, d, _ in kept)
    sums, seen = Counter(), set()
    for e, d, v in kept:
        sums[e, d] += v
        seen.add((e, d))
    got = {(r.e, r.d): r for r in trailing_totals(df, "e", "d", ["v"], (1, 7, 30)).collect()}
    assert len(got) == 3 * ((last - first).days + 1)
    for (e, d), r in got.items():
        assert r.has_row == ((e, d) in seen)
        for w in (1, 7, 30):
            total = sum(sums[e, d - timedelta(i)] for i in range(w))
            days = min(w, (d - first).days + 1)
            assert (r[f"v_{w}d"], r[f"days_{w}d"]) == (total, days) and math.isclose(r[f"v_{w}d_avg"], total / days)
    assert trailing_totals(df.limit(0), "e", "d", ["v"]).count() == 0


# --- heavy keys ---


def test_heavy_keys(spark):
    rows = [("hot", i % 5) for i in range(500)] + [("warm", 1)] * 60 + [(f"k{i}", i % 7) for i in range(400)] + [(None, 3)] * 40
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    found = heavy_hitters(df, ["k", "v"], 0.06)
    assert found[1] == 1000 and {"hot", "warm"} <= set(found[0]["k"]) and set(found[0]["v"]) == set(range(7))
    assert sorted(map(tuple, heavy_counts(df, ["k"], 0.06).collect())) == [("k", "hot", 500), ("k", "warm", 60)]
    assert [tuple(r) for r in heavy_counts(df, ["k", "v"], 0.5).collect()] == [("k", "hot", 500)]
    with pytest.raises(ValueError):
        heavy_hitters(df, ["k"], 1e-6)
    both = per_keys(df, ["k", "v"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": "sum", "s": "sum"}, 0.06)
    by_v = {r.key_value: (r.n, r.s) for r in both.where("key_column = 'v'").collect()}
    assert by_v == {str(r.v): (r.n, r.s) for r in df.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    assert {r.key_value for r in both.where("key_column = 'k' AND is_heavy").collect()} >= {"hot", "warm"}
    # Two scans whatever the number of columns: the sketches (done), and the one that both weights share.
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("ReusedQueryStage") >= 1 or "ResultQueryStage" in plan
    got = per_key(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v"), "top": F.max("v")}, {"n": "sum", "s": "sum", "top": "max"}, 0.06)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("v").alias("top"))
    assert sorted(map(str, got.drop("is_heavy").collect())) == sorted(map(str, plain.collect()))
    assert per_key(df.limit(0), "k", {"n": F.count(F.lit(1))}, {"n": "sum"}, 0.06).count() == 0
    dim = spark.createDataFrame([("hot", "H"), ("k1", "K")], "dk string, label string")
    joined = skew_join(df, dim, "k", "dk", 0.06)
    assert joined.count() == 1000 and joined.where("label = 'H'").count() == 500 and joined.where("k IS NULL AND label IS NULL").count() == 40


# --- profile ---


def test_profile_metrics_and_deltas(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", True, None, [1]), (10, "a", None, None, [1]), (None, "a", True, None, None), (9, None, False, None, [2])], "n int, value string, load boolean, void string, arr array<int>")
    got = {r.column_name: r for r in metrics(value_counts(df, "t")).collect()}
    assert (got["n"].min_value, got["n"].max_value, got["n"].distinct_values, got["n"].null_rate) == ("1", "10", 3, 0.25)
    assert (got["value"].min_value, got["value"].max_value, got["value"].top_count) == ("a", "b", 2)
    assert math.isclose(got["value"].entropy, -(1 / 3) * math.log(1 / 3) - (2 / 3) * math.log(2 / 3))
    assert (got["void"].nulls, got["void"].distinct_values, got["void"].min_value, got["void"].entropy) == (4, 0, None, None)
    assert got["arr"].distinct_values == 2
    assert metrics(value_counts(df.limit(0), "t")).count() == 0
    store = ValueCountStore(spark, str(tmp_path / "store"))
    assert store.state().count() == 0
    store.apply("one", value_counts(df, "t"))
    store.apply("one", value_counts(df, "t"))
    gone = df.where("n = 10")
    state = store.apply("two", value_counts(gone, "t", sign=-1), value_counts(gone.withColumn("n", F.lit(4)), "t"))
    want = value_counts(df.where("n IS NULL OR n <> 10").unionByName(gone.withColumn("n", F.lit(4))), "t")
    assert sorted(map(str, state.collect())) == sorted(map(str, apply_delta(want).collect()))
    assert [n for n, _ in store.versions()] == [1, 2]
    some = store.state([("t", "value")]).collect()
    assert {r.column_name for r in some} == {"value"} and len(some) == 3


def test_a_load_rewrites_only_what_it_touches(spark, tmp_path):
    store = ValueCountStore(spark, str(tmp_path / "store"), buckets=4)
    store.apply("one", value_counts(spark.range(1000).selectExpr("id AS a", "id % 10 AS b", "'x' AS c"), "t"))
    store.apply("two", value_counts(spark.createDataFrame([(5,)], "b long"), "t", ["b"]), value_counts(spark.createDataFrame([("x",)], "c string"), "t", ["c"], sign=-1))
    folders = lambda v: sorted(p.name for p in (tmp_path / "store" / "data" / f"v={v:08d}").glob("part=*"))
    assert len(folders(1)) >= 7 and len(folders(2)) == 2  # one bucket of b, one of c; none of a
    got = {(r.column_name, r.value): r.n for r in store.state().collect() if r.column_name != "a"}
    assert got["b", "5"] == 101 and got["b", "4"] == 100 and got["c", "x"] == 999
    store.apply("three", value_counts(spark.range(999).selectExpr("'x' AS c"), "t", sign=-1))
    assert store.state([("t", "c")]).count() == 0 and store.state([("t", "a")]).count() == 1000
    again = ValueCountStore(spark, str(tmp_path / "store"))
    assert [load for _, load in again.versions()] == ["one", "two", "three"] and again.state([("t", "b")]).count() == 10


def test_violations(spark):
    df = spark.createDataFrame([(0, "a", "a: x"), (2, "a", "b: x"), (None, None, "a: y"), (2, "b", None)], "v int, r string, d string").withColumn("pair", F.struct("r", "d"))
    said = F.from_json("value", "v struct<r: string, d: string>")["v"]
    rules = [Rule("t", "v", F.col("value_num") > 1), Rule("t", "d", said["d"].isNotNull() & ~F.coalesce(said["d"].startswith(said["r"]), F.lit(False)), "pair")]
    got = {r.column_name: r.violations for r in metrics(value_counts(df, "t"), rules).collect()}
    assert got == {"v": 2, "r": None, "d": 2}
    assert metrics(value_counts(df.limit(0), "t"), rules).count() == 0


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    assert read_text(spark, path) is None
    for text in ("é1", "twö", ""):
        write_text(spark, path, text)
        assert read_text(spark, path) == text


def test_sizes(spark):
    a, b = sizes_of(spark.range(10), spark.createDataFrame([("x" * 1000, [1]), (None, None)], "s string, l array<int>"))
    assert (a.rows, a.bytes) == (10, 240) and b.rows == 2 and 1064 <= b.bytes < 1200


def test_shift_between_loads(spark):
    rows = [("1", "a")] * 3 + [("1", "b")] + [("2", "a")] * 2 + [("2", "c")] * 2 + [("4", None)] * 2
    got = {r.load: r for r in load_shift(value_counts(spark.createDataFrame(rows, "l string, v string"), "t", ["v"], by=F.col("l"))).collect()}
    assert got["1"].shift is None and math.isclose(got["2"].shift, 0.5) and math.isclose(got["4"].shift, 1.0)
    assert got["4"].null_rate == 1.0 and got["2"].rows == 4


def test_exact_percentiles(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 7.5, rng.random() * 100])) for _ in range(3000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0], ["low", "mid", "p95", "top"]).collect()}
    want = {r.g: r for r in df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in (("low", 0), ("mid", 0.5), ("p95", 0.95), ("top", 1))], F.count("v").alias("n")).collect()}
    assert set(got) == set(want) == {"a", "b", None, "one", "two"}
    for g, r in want.items():
        assert got[g].n == r.n and all(math.isclose(got[g][c], r[c]) for c in ("low", "mid", "p95", "top"))
    assert exact_percentiles(df.limit(0), ["g"], "v", [0.5], ["m"]).count() == 0
