import hashlib
import json

from pyspark.sql import functions as F

from quaystone import schema
from quaystone.cli import main


def test_load_finalize_query(spark, sf, tmp_path, capsys):
    export, lake = tmp_path / "export", str(tmp_path / "lake")
    for t in (schema.DIM_DATE, schema.DIM_RELATION):
        spark.read.parquet(f"{sf}/{t.name}.parquet").select(*t.columns).write.parquet(str(export / t.name))
    spark.read.parquet(f"{sf}/dim_station.parquet").select(*[c for c in schema.DIM_STATION.columns if c != "observed_stop_events"]).write.parquet(str(export / "dim_station"))
    fact = spark.read.parquet(f"{sf}/fact_stop_event.parquet").select(*schema.EXPORT.columns)
    fact.write.partitionBy("date_key").parquet(str(export / "fact_stop_event"))

    days = fact.agg(F.min("date_key").alias("a"), F.max("date_key").alias("b"), F.count(F.lit(1)).alias("n")).first()
    years = {str(r.y): r.n for r in fact.groupBy(F.year("date_key").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"contract_version": 2, "exported_at": "2026-09-01T00:00:00Z", "fact_stop_event": {"min_date_key": str(days.a), "max_date_key": str(days.b), "total_rows": days.n, "rows_per_year": years}, "dimensions": {"dim_date": 10227, "dim_station": 4001, "dim_relation": 300}}

    def tell(**dimensions):
        (export / "manifest.json").write_text(json.dumps({**manifest, "dimensions": {**manifest["dimensions"], **dimensions}}))

    def run(*args):
        code = main([*args[:1], "--lake", lake, *args[1:]], spark)
        out = capsys.readouterr()
        return code, json.loads(out.out) if code == 0 else out.err

    assert "no manifest" in run("load-dims", "--export", str(export))[1]
    tell(dim_station=4000)
    assert "the manifest has 4000" in run("load-dims", "--export", str(export))[1]
    tell()
    assert run("load-dims", "--export", str(export))[1]["dim_station"] == {"inserted": 4001}
    assert run("load-dims", "--export", str(export))[1]["dim_station"] == {"updated": 4001}
    span = ("--from", "2026-07-01", "--to", "2026-07-08")
    wanted = fact.where("date_key >= DATE '2026-07-01' AND date_key < DATE '2026-07-08'").count()
    assert run("load-fact", "--export", str(export), *span) == (0, {"loaded": wanted, "rejected": 0})
    assert run("load-fact", "--export", str(export), *span) == (0, {"loaded": wanted, "rejected": 0})
    # A row that breaks a rule is left out, and then the range is not whole: nothing is published.
    spoilt = str(tmp_path / "spoilt")
    scope = fact.where("date_key >= DATE '2026-07-01' AND date_key < DATE '2026-07-08'")
    scope.withColumn("station_key", F.when(F.col("train_no") == scope.first().train_no, F.lit(99_999_999)).otherwise(F.col("station_key"))).write.partitionBy("date_key").parquet(f"{spoilt}/fact_stop_event")
    (tmp_path / "spoilt" / "manifest.json").write_text(json.dumps(manifest))
    code, err = run("load-fact", "--export", spoilt, *span, "--on-violation", "skip")
    assert code == 1 and f"{wanted} on disk in range" in err
    code, got = run("load-fact", "--export", spoilt, *span, "--on-violation", "skip", "--no-manifest")
    assert code == 1 or got["rejected"] > 0
    (tmp_path / "spoilt" / "manifest.json").unlink()
    code, got = run("load-fact", "--export", spoilt, *span, "--on-violation", "skip", "--no-manifest")
    assert code == 0 and got["rejected"] > 0 and got["loaded"] + got["rejected"] == wanted
    assert run("load-fact", "--export", str(export), *span) == (0, {"loaded": wanted, "rejected": 0})
    code, err = run("load-fact", "--export", str(export / "none"))
    assert code == 1 and "ScanError" in err
    assert run("finalize")[0] == 0
    assert run("profile")[1]["fact_rows"] == wanted
    assert spark.read.parquet(f"{lake}/gold/dim_station").agg(F.sum("observed_stop_events")).first()[0] == spark.read.parquet(f"{lake}/gold/fact_stop_event").agg(F.sum("stop_events")).first()[0]
    code, got = run("query", "SELECT COUNT(*) AS n FROM gold.fact_stop_event WHERE date_key = DATE '2026-07-01'")
    assert code == 0 and got["rows"][0][0] > 0 and got["findings"] == []
    assert run("query", "DROP TABLE gold.fact_stop_event")[0] == 1
    replies, cases, out = str(tmp_path / "replies.json"), tmp_path / "cases.json", str(tmp_path / "out.jsonl")
    code, err = run("ask", "--replies", replies, "How many rows in total?")
    assert code == 1 and "no stored reply" in err
    from quaystone.context import prompts
    from quaystone.context.profile import load
    from quaystone.operators.runlog import ProfileSnapshot

    profile, source = load(spark, ProfileSnapshot(f"{replies}.profile"))
    assert source == "snapshot" and profile["fact_rows"] == wanted and len(profile["known_stations"]) == 12
    system = prompts.context(sorted(f"gold.{n}" for n in schema.STAR), profile)
    sql = "SELECT COUNT(*) AS n FROM gold.fact_stop_event"
    stored = {prompts.sql_prompt(system, "How many rows in total?"): sql, prompts.answer_prompt("How many rows in total?", ["n"], [(wanted,)]): "So many."}
    (tmp_path / "replies.json").write_text(json.dumps({hashlib.sha256(k.encode()).hexdigest(): v for k, v in stored.items()}))
    code, got = run("ask", "--replies", replies, "How many rows in total?")
    assert got["rows"] == [[wanted]] and got["text"] == "So many."
    cases.write_text(json.dumps([{"id": "a", "question": "How many rows in total?", "sql": sql, "spec": {"mode": "scalar"}}, {"id": "b", "question": "How many rows in total, DROP TABLE x?", "behaviour": "refused"}]))
    code, got = run("eval", "--replies", replies, "--cases", str(cases), "--out", out)
    assert got["sql"] == {"passed": 1, "of": 1}
    assert run("ping")[1]["fact_stop_event"] is True and run("drop")[0] == 1
    runs = spark.read.parquet(f"{lake}/ops/load_runs").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in runs} == {"running": 7, "succeeded": 4, "failed": 3}
    assert run("drop", "--yes")[0] == 0 and run("ping")[1]["fact_stop_event"] is False
    spark.sql("DROP DATABASE gold CASCADE")


def test_empty_lake(spark, tmp_path, capsys):
    lake = str(tmp_path / "empty")
    assert main(["db-init", "--lake", lake], spark) == 0
    assert set(json.loads(capsys.readouterr().out)["made"]) == set(schema.STAR)
    assert main(["db-init", "--lake", lake], spark) == 0 and json.loads(capsys.readouterr().out)["made"] == []
    spark.sql("DROP DATABASE gold CASCADE")
    assert main(["kb-init", "--lake", lake, "--dimensions", "4"], spark) == 0 and json.loads(capsys.readouterr().out) == {"made": True}
    assert main(["kb-drop", "--lake", lake], spark) == 1 and main(["kb-drop", "--lake", lake, "--yes"], spark) == 0


def test_knowledge_base(spark, tmp_path, capsys):
    lake, corpus = str(tmp_path / "lake"), tmp_path / "md"
    corpus.mkdir()
    (corpus / "a.md").write_text("# One\n" + "first words " * 30 + "\n# Two\n" + "second words " * 30)
    args = ["--lake", lake, "--dimensions", "16"]
    assert main(["kb-build", *args, "--corpus", str(corpus)], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"inserted": 2}
    (corpus / "a.md").write_text("# One\n" + "first words " * 30 + "\n# Two\n" + "other words " * 30)
    main(["kb-build", *args, "--corpus", str(corpus)], spark)
    assert json.loads(capsys.readouterr().out) == {"unchanged": 1, "updated": 1}
    assert main(["kb-search", *args, "anything"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
