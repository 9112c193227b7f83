"""Registered queries that take whole tables: nothing is left out before the operator sees it."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quaystone.functions import vectors
from quaystone.queries import data_ops, star, star_sql
from quaystone.session import table
from tests.against_sql import check, connect


def test_sync_holds_every_position(spark, sf):
    kb = table(spark, sf, "kb_chunk")
    positions = {tuple(r) for r in kb.select("doc_id", "chunk_index").collect()}
    stored, corpus = star.sync_sides(kb)
    assert stored.count() == corpus.count() == len(positions)
    assert {tuple(r)[:2] for r in corpus.collect()} == positions
    got = {r.outcome: r.positions for r in star.w5_sync(spark, sf).collect()}
    assert set(got) == {"inserted", "updated", "unchanged", "deleted"} and sum(got.values()) - got["deleted"] == len(positions)


def test_set_operations_hold_every_row(spark, sf):
    fact, stg = table(spark, sf, "fact_stop_event"), table(spark, sf, "stg_fact_stop_event")
    stations = {r[0] for x in (fact, stg) for r in x.select("station_key").collect()}
    got = [r.station_key for r in star.u1_union(spark, sf).collect()]
    assert len(got) == len(stations) and set(got) == stations
    pairs = [Counter(map(tuple, x.select("station_key", "planned_hour").collect())) for x in (stg, fact)]
    want = pairs[0] - pairs[1]
    assert {tuple(r)[:2]: r.rows for r in star.u2_multiset_difference(spark, sf).collect()} == want
    assert any(hour is None or hour >= 6 for _, hour in want)


def test_search_answers_every_query(spark, sf):
    asked = {r.vec_id for r in table(spark, sf, "embeddings").where("vec_id % 50 = 0").collect()}
    assert len(asked) > 1
    got = Counter(r.query_id for r in star.l6_nearest(spark, sf).collect())
    assert got == dict.fromkeys(asked, 5)


def test_nearest_set_equals_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    monkeypatch.setattr(vectors, "_STRIP", 4)
    rng = random.Random(1)
    some = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame([*some, (60, None, 0), (61, [0.0, 0.0, 0.0], 0), (62, [1.0, None, 0.0], 0), (63, [1.0, 2.0], 0), (64, [1.0, 2.0], 1)], "id int, v array<float>, label int")
    got = vectors.nearest_set(df, df.where("id % 5 = 0 OR id > 60"), "v", 6, "id", exclude=F.col("label") == 2, floor=0.9, keep=["label"])
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((-r.similarity, r.id, r.label, r.kept))
    asked = [(i, v) for i, v, _ in some if i % 5 == 0 and any(v)] + [(63, [1.0, 2.0]), (64, [1.0, 2.0])]
    assert set(rows) == {i for i, _ in asked}
    for i, v in asked[::4] + asked[-2:]:
        near = vectors.nearest(df, "v", v, 6, ["id"], exclude=F.col("label") == 2, floor=0.9).collect()
        assert sorted(rows[i]) == [(-r.similarity, r.id, r.label, r.kept) for r in near]


def test_redact_reads_the_texts(spark, tmp_path):
    long = "x " * 20_000
    texts = ["plain", long + "postgres://u:hidden@h/db and token = abc; " + long, "Token-ring, secret: 'x'\nhttp://a:b@c", "secretary: at 12:30 @ desk", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in star.t8_redact(spark, str(tmp_path)).collect()}
    assert got == {0: "plain", 1: long + "postgres://u:***@h/db and token = ***; " + long, 2: "Token-ring, secret: '***'\nhttp://a:***@c", 3: "secretary: at 12:30 @ desk", 4: None}
    con = connect(str(tmp_path))
    check(spark, con, str(tmp_path), star.t8_redact, star_sql.SQL["t8_redact"])


def test_profile_counts_rows_without_a_day(spark, sf, tmp_path):
    for t in ("dim_station", "dim_relation", "dim_date"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    fact = table(spark, sf, "fact_stop_event")
    undated = fact.limit(5).withColumn("date_key", F.lit(None).cast("date"))
    fact.unionByName(undated).write.parquet(str(tmp_path / "fact_stop_event.parquet"))
    got = [r for r in data_ops.p6_profile(spark, str(tmp_path)).collect() if r.table_name == "fact_stop_event"]
    assert {r.rows for r in got} == {fact.count() + 5} and {r.nulls for r in got if r.column_name == "date_key"} == {5}


def test_shift_of_every_dimension(spark, sf):
    got = {(r.table_name, r.column_name, r.load) for r in data_ops.p6_shift_dimensions(spark, sf).collect()}
    for t in ("dim_relation", "dim_date"):
        df = table(spark, sf, t)
        days = {str(r[0]) for r in df.select(F.to_date("loaded_at")).collect()}
        assert {x for x in got if x[0] == t} == {(t, c, day) for c in df.columns for day in days} and len(days) > 1
