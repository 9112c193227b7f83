from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quaystone import schema
from quaystone.functions import layout, text, vectors
from quaystone.operators import merge, quality, rollups
from quaystone.operators.runlog import ProfileSnapshot, RunLog
from quaystone.sources import scan
from quaystone.sources.scan import Scope, ScanError

K = "k" * 32


def _row(day=date(2026, 8, 23), station=455, stop=K, relation="r" * 32, train=501, punctual=1):
    return (day, station, stop, relation, train, 8, 12, 15, 3, punctual, 1)


@pytest.fixture(scope="module")
def dims(spark):
    return (
        spark.createDataFrame([(date(2026, 8, d),) for d in range(1, 31)], "date_key date"),
        spark.createDataFrame([(455,), (-1,), (456,)], "station_key int"),
        spark.createDataFrame([("r" * 32,)], "relation_key string"),
    )


def _batch(spark, rows):
    return spark.createDataFrame(rows, schema.EXPORT.struct.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


def test_planted_faults(spark, dims):
    rows = [_row(), _row(stop=None, train=1), _row(train=2), _row(train=2, punctual=0), _row(day=date(2030, 1, 1), train=3), _row(station=9, relation="x" * 32, train=4), _row(station=None, train=5), _row(day=None, train=6)]
    flags = quality.flagged(_batch(spark, rows), *dims)
    assert {r.rule: r.rows_failed for r in quality.rule_counts(flags).collect()} == {"null_keys": 3, "duplicate_grain": 2, "orphan_date": 1, "orphan_station": 1, "orphan_relation": 1}
    assert [r.train_no for r in quality.valid(flags).collect()] == [501]
    assert quality.samples(flags).count() == 8
    assert quality.integrity(_batch(spark, rows), *dims).first().orphan_rows == 2
    fact, bad = merge.load_fact(flags, None, Scope(date(2026, 8, 1), date(2026, 9, 1)), "fail")
    assert fact is None and bad.count() == 6
    fact, bad = merge.load_fact(flags, None, Scope(date(2026, 8, 1), date(2026, 9, 1)), "skip")
    assert fact.count() == 1 and fact.first().measured_arrivals == 1


def test_contracts(spark):
    rows = [_row(), _row(punctual=2), _row(punctual=None), _row(stop="short")]
    got = {r.rule: r.rows_failed for r in scan.violations(_batch(spark, rows), schema.EXPORT).collect()}
    assert got["punctual_range"] == 1 and got["stop_point_key_length"] == 1 and got["date_key_required"] == 0
    assert [r.broken_rules for r in scan.offenders(_batch(spark, rows), schema.EXPORT).collect()] == [["punctual_range"], ["stop_point_key_length"]]
    assert "PRIMARY KEY (date_key, stop_point_key, train_no)" in schema.render(["gold.fact_stop_event"])
    with pytest.raises(KeyError):
        schema.render(["gold.other"])


def test_partitioned_scan(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = [_row(day=date(2026, 8, d), train=d) for d in range(1, 9)]
    merge.publish(_batch(spark, rows), path, "date_key")
    merge.publish(_batch(spark, rows), path, "date_key")
    assert scan.is_partitioned(spark, path) and not scan.is_partitioned(spark, str(tmp_path))
    df = scan.read_table(spark, path, schema.EXPORT, Scope(date(2026, 8, 2), date(2026, 8, 5)), ["date_key", "train_no"])
    assert sorted(r.train_no for r in df.collect()) == [2, 3, 4]
    assert "PartitionFilters: [isnotnull(date_key" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ScanError, match="missing columns \\['measured_arrivals'\\]"):
        scan.read_table(spark, path, schema.FACT)
    with pytest.raises(ScanError):
        scan.parquet_files(spark, str(tmp_path / "none"))
    with pytest.raises(ScanError):
        Scope(date(2026, 8, 5), date(2026, 8, 5))


GOOD = '{"contract_version": 2, "exported_at": "2026-09-01T00:00:00Z", "fact_stop_event": {"min_date_key": "2026-06-01", "max_date_key": "2026-08-29", "total_rows": 5, "rows_per_year": {"2026": 5}}, "dimensions": {"dim_date": 3}}'


def test_manifest():
    m = scan.read_manifest(GOOD)
    assert m.total_rows == 5 and scan.coverage_gate(m, 5, 5) == [] and scan.coverage_gate(m, 4, 5)
    assert scan.coverage_gate(m, 2, 2, Scope(date(2026, 6, 1), date(2026, 6, 3))) == []
    assert scan.coverage_gate(m, 2, 3, Scope(date(2026, 1, 1), date(2026, 6, 3))) != []
    assert scan.coverage_gate(m, 1, 2, Scope(date(2026, 6, 1), date(2026, 6, 3))) != [] and scan.coverage_gate(m, 2, 2, Scope(end=date(2026, 8, 30))) == [] and scan.coverage_gate(m, 2, 2, Scope(end=date(2026, 8, 31))) != []
    assert scan.dimension_gate(m, "dim_date", 3) == [] and scan.dimension_gate(m, "dim_date", 2) and scan.dimension_gate(m, "dim_other", 0)
    for bad in ("{", "[]", GOOD.replace('"contract_version": 2', '"contract_version": 1'), GOOD.replace('"2026": 5', '"2026": 4'), GOOD.replace("2026-06-01", "2027-06-01"), GOOD.replace('"dimensions"', '"other"')):
        with pytest.raises(ScanError):
            scan.read_manifest(bad)


def test_blocks_and_corpus(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind":"heading","text":"H","level":1}\n\n{"kind":"table_row","section":"S","cells":{"t":"x"}}\nnot json\n{"kind":"other"}\n')
    got = scan.read_blocks(spark, str(tmp_path / "a.jsonl")).collect()
    assert len(got) == 4 and sorted(r.error for r in got if r.error) == ["not json", '{"kind":"other"}']
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "doc.md").write_text("intro\n# One\nbody\n\n## Two\nmore")
    assert [tuple(r) for r in scan.read_corpus(spark, str(tmp_path / "md")).collect()] == [("doc", "intro\n# One\nbody\n\n## Two\nmore")]
    assert scan.digests(spark, str(tmp_path / "md")).count() == 1


def test_rollups(spark):
    rows = [(date(2026, 1, 1), 1, 2, 1, 1), (date(2026, 1, 1), 1, 1, 0, None), (date(2026, 1, 2), 1, 1, 1, 0)]
    fact = spark.createDataFrame(rows, "date_key date, station_key int, stop_events int, measured_arrivals int, punctual_arrivals int")
    roll = rollups.rollup(fact, "station_key")
    assert sorted(tuple(r)[2:] for r in roll.collect()) == [(1, 1, 1, 0), (2, 3, 1, 1)]
    assert rollups.difference(fact, roll, "station_key").count() == 0
    assert rollups.freshness(fact, roll).first().is_fresh
    assert not rollups.freshness(fact.unionByName(fact.limit(1)), roll).first().is_fresh
    assert rollups.freshness(fact.limit(0), roll.limit(0)).first().is_fresh
    assert fact.limit(0).agg(rollups.rate().alias("r")).first().r is None


def test_upsert_sync_and_scope(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"]).collect())) == [(1, "a", "kept"), (2, None, "updated"), (3, "c", "inserted")]
    s = spark.createDataFrame([("d", 0, "h"), ("d", 1, None), ("d", 2, "x")], "doc_id string, chunk_index int, content_hash string")
    c = spark.createDataFrame([("d", 0, "h"), ("d", 1, "n"), ("d", 3, "y"), ("d", 4, "z"), ("d", 4, "z")], "doc_id string, chunk_index int, content_hash string")
    assert {r.chunk_index: r.outcome for r in merge.sync(s, c).collect()} == {0: "unchanged", 1: "updated", 2: "deleted", 3: "inserted", 4: "duplicate"}
    days = spark.createDataFrame([(date(2026, 1, d), "old") for d in range(1, 6)], "date_key date, v string")
    fresh = spark.createDataFrame([(date(2026, 1, 2), "new"), (date(2026, 1, 9), "new")], "date_key date, v string")
    out = merge.replace_scope(days, fresh, Scope(date(2026, 1, 2), date(2026, 1, 4)))
    assert sorted((r.date_key.day, r.v) for r in out.collect()) == [(1, "old"), (2, "new"), (4, "old"), (5, "old")]


def test_run_log_and_snapshot(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    a, b = log.start("x"), log.start("y")
    log.finish(a, 5, 1)
    log.fail(b, "e" * 5000)
    got = {r.run_id: r for r in log.latest().collect()}
    assert got[a].status == "succeeded" and got[a].rows_loaded == 5 and got[b].status == "failed" and len(got[b].error) == 2000
    snap = ProfileSnapshot(str(tmp_path / "p.json"))
    assert snap.read({"k": 1}) is None
    snap.write({"k": 1}, {"rows": 3})
    assert snap.read({"k": 1}) == {"rows": 3} and snap.read({"k": 2}) is None


def test_text_functions(spark):
    df = spark.createDataFrame([("postgres://u:secret@h/db password=abc, token: 'x1' api-key=\"q\" plain",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "postgres://u:***@h/db password=***, token: '***' api-key=\"***\" plain"
    doc = spark.createDataFrame([("d", "intro\n# One #\nbody a\n\nbody b\n## Two\n\n" + "x" * 40)], "doc_id string, text string")
    assert [(r.heading, r.body) for r in text.sections(doc, "doc_id", "text").collect()] == [(None, "intro"), ("One #", "body a\n\nbody b"), ("Two", "x" * 40)]
    bodies = ["\n\n".join(["a" * 5, "b" * 5, "c" * 30, "d"]), " short \n\n as it is", "x" * 12, "x" * 13, "a\n \n\nb\n\n" + "c" * 11, "", "a" * 11 + "\n\n\n\n" + "b" * 4]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(text.packed(F.col("b"), 12)).collect()]
    # What is left of a paragraph that was cut hard stands alone; a body that fits stays as it is.
    assert got == [["aaaaa\n\nbbbbb", "c" * 12, "c" * 12, "c" * 6, "d"], [" short ", " as it is"], ["x" * 12], ["x" * 12, "x"], ["a\n\nb", "c" * 11], [""], ["a" * 11, "b" * 4]]
    fits = spark.createDataFrame([(" a \n \n\n b ",)], "b string")
    assert fits.select(text.packed(F.col("b"), 12)).first()[0] == [" a \n \n\n b "]
    out = text.chunks(doc, "doc_id", "text", 20, 8).orderBy("chunk_index").collect()
    assert [r.content for r in out] == ["intro", "body a\n\nbody b", "x" * 20, "x" * 20] and out[1].heading == "One #"
    short = spark.createDataFrame([("d", 0, "ab"), ("d", 1, "long enough"), ("d", 2, "cd"), ("d", 3, "")], "doc string, i int, t string")
    assert sorted((r.i, r.t) for r in text.merge_short(short, "doc", "i", "t", 5).collect()) == [(0, "ab"), (1, "long enough\n\ncd\n\n")]
    q = spark.createDataFrame([("How many trains in 2026?",), ("What does punctual mean",), ("hello",), ("Explain how many trains were counted in total in 2026",), ("what does it mean in 1999",)], "t string")
    assert [r[0] for r in q.select(text.route(F.col("t"))).collect()] == ["data", "conceptual", None, None, None]
    lines = spark.createDataFrame([("Page\u00a0 3\tof ١٢",), ("PAGE 4 of 9",)], "t string")
    assert [r[0] for r in lines.select(text.line_shape(F.col("t"))).collect()] == ["Page # of #", "PAGE # of #"]


def test_glossary(spark):
    rows = [("d", 0, "table_row", "S", {"t": " Term\n one ", "x": "first"}), ("d", 1, "table_row", "S", {"t": "", "x": "more"}), ("d", 2, "table_row", "S", {"t": "Two", "x": ""}), ("d", 3, "heading", "S", None)]
    df = spark.createDataFrame(rows, "doc string, at int, kind string, section string, cells map<string,string>")
    got = [(r.chunk_index, r.heading, r.content) for r in text.glossary(df, "doc", "at", "t", {"x": "Meaning"}).orderBy("chunk_index").collect()]
    assert got == [(0, "S — Term one", "first\n\nmore"), (1, "S — Two", "Two")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [2.0, 0.0]), (5, [0.0, 0.0])], "id int, v array<float>")
    got = vectors.nearest(df, "v", [1.0, 0.0], 3, ["id"], floor=0.5).collect()
    assert [(r.id, r.kept) for r in got] == [(1, True), (4, True), (2, False)]
    assert vectors.widths(df, "v", 2).first().fits
    a, b = vectors.SeededEmbedder(8).embed(["x", "x"])
    (c,) = vectors.SeededEmbedder(8, "another").embed(["x"])
    assert a == b != c and abs(sum(x * x for x in a) - 1) < 1e-9


def test_layout(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 1.5), ("p", 9.0), ("q", 4.0)], "page string, x double")
    assert sorted((r.page, r.centre, r.members) for r in layout.clusters(df, ["page"], "x", 1.0).collect()) == [("p", 1.25, 2), ("p", 9.0, 1), ("q", 4.0, 1)]
    lines = spark.createDataFrame([("d", p, t) for p in range(1, 6) for t in (f"Page {p}", f"body {chr(96 + p) * p}")], "doc string, page int, t string")
    assert [r["shape"] for r in layout.running_lines(lines, "doc", "page", "t").collect()] == ["Page #"]
    one = spark.createDataFrame([(1, "ab b")], "p int, t string")
    two = spark.createDataFrame([(1, "ab"), (1, "c")], "p int, t string")
    assert sorted((r.char, r.lost) for r in layout.lost_characters(one, two, ["p"], "t").collect()) == [("b", 1), ("c", -1)]
    cell = spark.createDataFrame([(5.0, [0.0, 4.0, 8.0])], "x double, e array<double>").select(layout.cell_of(F.col("x"), F.col("e"))).first()[0]
    assert cell == 1


def test_ruled_grid(spark):
    # Three pages of one section. Marks under two columns at three heights on two pages, an underline, a thick panel, a bullet.
    drawn = [("d", p, x0 + shift, x1 + shift, y, y + 1) for p, shift in ((1, 0.0), (2, 0.4)) for y in (100.0, 140.0, 180.0) for x0, x1 in ((50.0, 150.0), (150.0, 300.0))]
    drawn += [("d", 1, 70.0, 130.0, 120.0, 121.0), ("d", 2, 50.0, 300.0, 200.0, 260.0), ("d", 2, 50.0, 60.0, 220.0, 220.5), ("d", 3, 70.0, 130.0, 500.0, 500.0)]
    shapes = spark.createDataFrame(drawn, "doc string, page int, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("e", 1)], "doc string, page int")
    rules = layout.page_rules(shapes, "doc", "page")
    assert rules.count() == 14  # the panel and the bullet are no edges
    columns = layout.column_edges(rules, pages, "doc", "page")
    got = {r.doc: r.edges for r in columns.collect()}
    assert set(got) == {"d"} and [round(e, 2) for e in got["d"]] == [50.2, 150.2, 300.2]
    rows = {r.page: r.rows for r in layout.row_edges(rules, columns, "doc", "page").collect()}
    assert rows == {1: [100.5, 140.5, 180.5], 2: [100.5, 140.5, 180.5]}  # the underline ends at no column, page 3 has no table
    # Marks drawn at one height only make no column, however many pages have them.
    once = spark.createDataFrame([("d", p, 50.0, 150.0, 10.0, 10.0) for p in (1, 2, 3)], shapes.schema)
    assert layout.column_edges(layout.page_rules(once, "doc", "page"), pages, "doc", "page").count() == 0
    one = spark.createDataFrame([([5.0, 1.0, 2.5, 4.4, 9.0],)], "x array<double>").select(layout.centres(F.col("x"))).first()[0]
    assert one == [(1.0 + 2.5 + 4.4 + 5.0) / 4, 9.0]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "id string, n int, v string")
    assert sorted(map(tuple, scan.last_wins(df, ["id"], ["n"]).collect())) == [("a", 2, None), ("b", 1, "y")]


def test_times(spark):
    assert Scope(date(2026, 1, 1)).start == date(2026, 1, 1) and datetime(2026, 1, 1)
    months = merge.month_partitions(spark, date(2025, 12, 5), date(2026, 2, 1)).collect()
    assert [r.partition_name for r in months] == ["p2025_12", "p2026_01", "p2026_02"] and months[0].end_day == date(2026, 1, 1)


def test_page_lines_and_grid(spark):
    words = spark.createDataFrame([("d", 1, 5.0, 10.0, "b"), ("d", 1, 1.0, 11.0, "a"), ("d", 1, 1.0, 14.5, "c"), ("d", 1, 99.0, 40.0, "out")], "doc string, page int, x double, y double, w string")
    got = layout.page_lines(words, ["doc", "page"], "x", "y", "w").orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b", "c", "out"]
    edges = spark.createDataFrame([("d", 0.0), ("d", 4.0), ("d", 9.0)], "doc string, edge double")
    rows = spark.createDataFrame([("d", 1, 9.0), ("d", 1, 13.0), ("d", 1, 20.0)], "doc string, page int, edge double")
    cells = {r.row: r.cells for r in layout.grid_rows(words, edges, rows, "doc", "page", "x", "y", "w").collect()}
    assert cells == {0: {0: "a", 1: "b"}, 1: {0: "c"}}


def test_config(tmp_path):
    from quaystone.config import ConfigError, EvaluationConfig, load

    f = tmp_path / "c.yaml"
    f.write_text("sql:\n  allowed_tables: [gold.dim_date]\n  blocked_functions: [Sleepy]\nsql_checks:\n  explain: true\n  max_scan_bytes: 5\n")
    policy = load(str(f)).policy()
    assert policy.tables == {"gold.dim_date"} and policy.max_scan_bytes == 5 and "sleepy" in policy.blocked_functions and "reflect" in policy.blocked_functions
    for bad in ("sql: {}", "sql: {allowed_tables: x}", "sql: {allowed_tables: [a], other: 1}", "sql: {allowed_tables: [a], max_rows: 0}", "sql: {allowed_tables: [a]}\nsql_checks: {max_scan_bytes: 4}", "- x", "sql: {allowed_tables: [a], max_rows: true}", "{"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load(str(f))
    f.write_text("top_k: 2")
    assert load(str(f), EvaluationConfig).top_k == 2


def test_profiles_and_sources(spark, tmp_path):
    import hashlib

    from quaystone.config import ConfigError, ProfileSet, SourceRegistry, load
    from quaystone.sources.fetch import fetch

    f = tmp_path / "m.yaml"
    f.write_text("active: small\nprofiles:\n  small: {provider: canned, generator: g, embedder: e, dimensions: 8}\n  large: {provider: canned, generator: g2, embedder: e2, dimensions: 16, floor: 1}\n")
    models = load(str(f), ProfileSet)
    assert models.select().dimensions == 8 and models.select("large").floor == 1.0
    with pytest.raises(ConfigError):
        models.select("huge")
    for bad in ("active: other\nprofiles: {small: {provider: c, generator: g, embedder: e, dimensions: 8}}", "active: small\nprofiles: {}", "active: small\nprofiles: {small: {provider: c, generator: g, embedder: e, dimensions: 8, x: 1}}"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load(str(f), ProfileSet)
    body = b"%PDF- a document"
    one = "{source_id: guide, title: T, publisher: P, canonical_url: 'https://host.example/a/guide.pdf', version: '1.2', language: en, sha256: %s}"
    f.write_text(f"sources: [{one % hashlib.sha256(body).hexdigest()}]")
    source = load(str(f), SourceRegistry).select("guide")
    asked = []
    get = lambda url: asked.append(url) or body
    path, now = fetch(spark, source, str(tmp_path / "docs"), get)
    assert now and path.endswith("/guide__1.2.pdf") and not fetch(spark, source, str(tmp_path / "docs"), get)[1] and asked == [source.canonical_url]
    with pytest.raises(ScanError, match="pinned"):
        fetch(spark, source, str(tmp_path / "other"), lambda url: b"republished")
    assert not (tmp_path / "other").exists()
    for bad in ("sources: []", f"sources: [{one % 'short'}]", f"sources: [{one % ('0' * 64)}, {one % ('1' * 64)}]", f"sources: [{(one % ('0' * 64)).replace('guide,', '../guide,')}]"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load(str(f), SourceRegistry)
