"""Command line over the operators: a file-system catalogue instead of a database."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone import schema
from quaystone.functions import text, vectors
from quaystone.operators import merge, quality, rollups
from quaystone.operators.runlog import RunLog
from quaystone.session import cut, read_text, ship_package
from quaystone.sources import scan
from quaystone.sources.scan import Scope

#: Texts of one call of the embedder.
EMBED_BATCH = 32
DIMENSIONS = (schema.DIM_DATE, schema.DIM_STATION, schema.DIM_RELATION)


def _gold(spark: SparkSession, lake: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{lake}/gold/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _source(spark: SparkSession, export: str, name: str) -> str:
    """The table's folder or file in an export."""
    for candidate in (f"{export}/{name}", f"{export}/{name}.parquet"):
        if _exists(spark, candidate):
            return candidate
    raise scan.ScanError(f"{export} has no {name}")


def _manifest(spark: SparkSession, a) -> scan.Manifest | None:
    """The export's manifest from whatever file system it lies on; None only if the caller said that there is none."""
    text = read_text(spark, f"{a.export}/manifest.json")
    if text is None and not a.no_manifest:
        raise scan.ScanError(f"{a.export} has no manifest.json")
    return scan.read_manifest(text) if text is not None else None


def load_dims(spark: SparkSession, a) -> dict:
    """Upsert the dimensions; counts are held against the manifest before anything is published."""
    manifest, merged = _manifest(spark, a), {}
    problems: list[str] = []
    for t in DIMENSIONS:
        new = scan.read_table(spark, _source(spark, a.export, t.name), t, optional=("observed_stop_events",), tolerate=("loaded_at",))
        broken = scan.violations(new, schema.Table(t.name, t.comment, {c: v for c, v in t.columns.items() if c in new.columns}, t.grain, rules=t.rules)).where("rows_failed > 0").collect()
        if broken:
            raise scan.ScanError(f"{t.name}: {[(r.rule, r.rows_failed) for r in broken]}")
        if "observed_stop_events" in t.columns and "observed_stop_events" not in new.columns:
            new = new.withColumn("observed_stop_events", F.lit(None).cast("int"))
        if manifest:
            problems += scan.dimension_gate(manifest, t.name, new.count())
        path = f"{a.lake}/gold/{t.name}"
        merged[t.name] = merge.upsert(_gold(spark, a.lake, t.name), new.select(*t.columns), list(t.grain)) if _exists(spark, path) else new.select(*t.columns).withColumn("outcome", F.lit("inserted"))
    if problems:
        raise scan.ScanError("; ".join(problems))
    out = {}
    for name, df in merged.items():
        out[name] = {r.outcome: r["count"] for r in df.groupBy("outcome").count().collect()}
        merge.publish(df.drop("outcome"), f"{a.lake}/gold/{name}")
    return out


def load_fact(spark: SparkSession, a) -> dict:
    """Validate, gate and replace the range. A rejected row stops the load or is left out, and always lands in quarantine."""
    log, scope = RunLog(spark, f"{a.lake}/ops/load_runs"), Scope(a.start, a.end)
    run = log.start(a.export)
    try:
        batch = scan.read_table(spark, _source(spark, a.export, "fact_stop_event"), schema.EXPORT, scope, tolerate=("loaded_at", "measured_arrivals"))
        # The flags are judged, counted, quarantined and promoted from one staged table.
        flags = cut(quality.flagged(batch, *[_gold(spark, a.lake, t.name) for t in DIMENSIONS]))
        path = f"{a.lake}/gold/fact_stop_event"
        now = _gold(spark, a.lake, "fact_stop_event") if _exists(spark, path) else None
        fact, bad = merge.load_fact(flags, now, scope, a.on_violation)
        rejected = bad.count()
        if rejected:
            bad.write.mode("overwrite").parquet(f"{a.lake}/ops/quarantine/{run}")
        if fact is None:
            raise scan.ScanError(f"{rejected} rows rejected")
        manifest = _manifest(spark, a)
        # What is to be published in scope, against what the files hold.
        loaded = fact.where(scope.column()).count()
        problems = scan.coverage_gate(manifest, loaded, batch.count(), scope) if manifest else []
        if problems:
            raise scan.ScanError("; ".join(problems))
        merge.publish(fact.repartitionByRange("date_key"), path, "date_key")
        log.finish(run, loaded, rejected)
        return {"loaded": loaded, "rejected": rejected}
    except Exception as e:
        log.fail(run, str(e))
        raise


def refresh_rollups(spark: SparkSession, a) -> dict:
    out = {}
    for name, key in (("agg_station_day", "station_key"), ("agg_relation_day", "relation_key")):
        merge.publish(rollups.rollup(_gold(spark, a.lake, "fact_stop_event"), key), f"{a.lake}/gold/{name}")
        out[name] = _gold(spark, a.lake, name).count()
    return out


def finalize(spark: SparkSession, a) -> dict:
    """Station activity, integrity over the finished load, rollups."""
    fact = _gold(spark, a.lake, "fact_stop_event")
    orphans = quality.integrity(fact, *[_gold(spark, a.lake, t.name) for t in DIMENSIONS]).first().orphan_rows
    if orphans:
        raise scan.ScanError(f"{orphans} facts have references that do not resolve")
    active = rollups.activity(_gold(spark, a.lake, "dim_station"), fact).withColumn("observed_stop_events", F.col("observed_stop_events").cast("int"))
    merge.publish(active.select(*schema.DIM_STATION.columns), f"{a.lake}/gold/dim_station")
    return refresh_rollups(spark, a)


def profile(spark: SparkSession, a) -> dict:
    return rollups.coverage_profile(_gold(spark, a.lake, "fact_stop_event")).first().asDict()


def kb_build(spark: SparkSession, a) -> dict:
    """Chunk a folder of Markdown, keep the vectors of unchanged positions, embed the rest."""
    corpus = text.chunks(scan.read_corpus(spark, a.corpus), "doc_id", "text")
    path, embedder = f"{a.lake}/rag/kb_chunk", vectors.SeededEmbedder(a.dimensions)
    columns = ["doc_id", "chunk_index", "content_hash", "embedding"]
    stored = spark.read.parquet(path).select(*columns) if _exists(spark, path) else spark.createDataFrame([], "doc_id string, chunk_index int, content_hash string, embedding array<double>")
    outcome = {r.outcome: r["count"] for r in merge.sync(stored, corpus).groupBy("outcome").count().collect()}
    if outcome.get("duplicate"):
        raise scan.ScanError("repeated positions in the corpus")
    ship_package(spark)
    kept = corpus.join(stored, ["doc_id", "chunk_index", "content_hash"], "left")

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        wanted = [i for i, t in enumerate(texts) if t is not None]
        for k in range(0, len(wanted), EMBED_BATCH):
            part = wanted[k : k + EMBED_BATCH]
            vectors_ = embedder.embed([texts[i] for i in part])
            if any(len(v) != a.dimensions for v in vectors_):
                raise ValueError(f"a vector of another width than {a.dimensions}")
            for i, v in zip(part, vectors_):
                out[i] = v
        return out

    # Only texts without a vector reach the embedder, in batches.
    missing = F.when(F.col("embedding").isNull(), text.embedding_text(F.col("heading"), F.col("content")))
    merge.publish(kept.withColumn("embedding", F.coalesce("embedding", embed(missing))), path)
    return outcome


def db_init(spark: SparkSession, a) -> dict:
    """Empty tables with the declared schemas where the lake has none, named in the catalogue; what was there stays."""
    made = []
    for name, t in schema.STAR.items():
        if not _exists(spark, f"{a.lake}/gold/{name}"):
            empty = spark.createDataFrame([], t.struct)
            merge.publish(empty, f"{a.lake}/gold/{name}", t.partitioned_by)
            made.append(name)
    return {"made": made, "tables": _register(spark, a.lake)}


def kb_init(spark: SparkSession, a) -> dict:
    """An empty chunk store of the given width; one of another width is an error."""
    path = f"{a.lake}/rag/kb_chunk"
    if not _exists(spark, path):
        merge.publish(spark.createDataFrame([], "doc_id string, chunk_index int, heading string, content string, content_hash string, embedding array<double>"), path)
        return {"made": True}
    other = [r.width for r in vectors.widths(spark.read.parquet(path), "embedding", a.dimensions).where("NOT fits").collect()]
    if other:
        raise scan.ScanError(f"the store holds vectors of width {other}, not {a.dimensions}")
    return {"made": False}


def kb_drop(spark: SparkSession, a) -> dict:
    """Remove the chunk store; the tables stay."""
    if not a.yes:
        raise scan.ScanError("nothing was dropped: say --yes")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{a.lake}/rag")
    return {"dropped": p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)}


def kb_search(spark: SparkSession, a) -> list:
    (q,) = vectors.SeededEmbedder(a.dimensions).embed([a.question])
    near = vectors.nearest(spark.read.parquet(f"{a.lake}/rag/kb_chunk"), "embedding", q, a.top, ["doc_id", "chunk_index"], floor=a.floor)
    return [[r.doc_id, r.heading, round(r.similarity, 4), r.kept] for r in near.collect()]


def docs_fetch(spark: SparkSession, a) -> dict:
    """Fetch a source of the registry under its pinned digest."""
    from quaystone.config import SourceRegistry, load
    from quaystone.sources.fetch import fetch

    path, now = fetch(spark, load(a.registry, SourceRegistry).select(a.source), f"{a.lake}/docs")
    return {"path": path, "fetched": now}


def docs_parse(spark: SparkSession, a) -> dict:
    blocks = scan.read_blocks(spark, a.blocks)
    bad = blocks.where("error IS NOT NULL").count()
    if bad:
        raise scan.ScanError(f"{bad} lines are no blocks")
    return {r.kind: r["count"] for r in blocks.groupBy("kind").count().collect()}


def _register(spark: SparkSession, lake: str) -> list[str]:
    """Name the lake's tables in the catalogue; the files stay where they are."""
    names = [n for n in schema.STAR if _exists(spark, f"{lake}/gold/{n}")]
    spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS gold.{n}")
        if key := schema.STAR[n].partitioned_by:
            # Declared, for an empty folder tells no columns.
            spark.sql(f"CREATE TABLE gold.{n} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.STAR[n].struct)}) USING parquet PARTITIONED BY ({key}) LOCATION '{lake}/gold/{n}'")
            spark.catalog.recoverPartitions(f"gold.{n}")
        else:
            spark.catalog.createTable(f"gold.{n}", f"{lake}/gold/{n}", "parquet")
    return names


def ping(spark: SparkSession, a) -> dict:
    """Which tables the lake holds."""
    return {n: _exists(spark, f"{a.lake}/gold/{n}") for n in schema.STAR}


def drop(spark: SparkSession, a) -> dict:
    """Remove the tables; the history of runs stays."""
    if not a.yes:
        raise scan.ScanError("nothing was dropped: say --yes")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.lake).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {n: fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{a.lake}/{n}"), True) for n in ("gold", "rag")}


def _pipeline(spark: SparkSession, a, generate):
    from quaystone.context.pipeline import AnswerPipeline
    from quaystone.context.profile import load
    from quaystone.operators.runlog import ProfileSnapshot
    from quaystone.plans.guard import Policy

    names = _register(spark, a.lake)
    chunks = spark.read.parquet(f"{a.lake}/rag/kb_chunk") if _exists(spark, f"{a.lake}/rag/kb_chunk") else None
    policy = Policy(frozenset(f"gold.{n}" for n in names))
    return AnswerPipeline(spark, policy, generate, chunks, vectors.SeededEmbedder(a.dimensions), profile=lambda: load(spark, ProfileSnapshot(f"{a.replies}.profile"))[0])


def _replay(path: str):
    """Replies of a stored run, by prompt hash; a prompt without one is an error, for there is no generator to ask."""
    from quaystone.evaluation.runner import ReplyCache

    def missing(prompt: str) -> str:
        raise RuntimeError("no stored reply for this prompt")

    return ReplyCache(path, missing)


def ask(spark: SparkSession, a) -> dict:
    """Answer a question from stored replies."""
    from quaystone.plans.execute import plain

    got = _pipeline(spark, a, _replay(a.replies)).answer(a.question)
    return {"route": got.route, "text": got.text, "sql": got.sql, "rows": [[plain(c) for c in r] for r in got.result.rows] if got.result else None, "sources": got.sources, "findings": got.findings}


def evaluate(spark: SparkSession, a) -> dict:
    """Run a golden set (JSON list of cases) and report."""
    from quaystone.context.pipeline import Unanswered
    from quaystone.evaluation.compare import Spec
    from quaystone.evaluation.runner import Case, ExpectedResults, Reply, report, run

    pipe = _pipeline(spark, a, _replay(a.replies))
    cases = [Case(**{**c, "spec": Spec(**c.get("spec", {})), "sources": tuple(map(tuple, c.get("sources", ()))), "tags": tuple(c.get("tags", ()))}) for c in json.loads(Path(a.cases).read_text())]
    expected = ExpectedResults(spark, f"{a.out}.expected", json.dumps(pipe.profile, default=str))

    def answer(question: str) -> Reply:
        try:
            got = pipe.answer(question)
        except Unanswered as e:
            return Reply("data", refused=str(e))
        return Reply(got.route, got.result.rows if got.result else None, got.sources)

    return report(run(cases, answer, expected.of, a.out), [c.id for c in cases])


def query(spark: SparkSession, a) -> dict:
    """A read-only query under guard, lint, ceiling and timeout."""
    from quaystone.plans.execute import check_cost, execute, plain
    from quaystone.plans.guard import Policy, analysed, validate
    from quaystone.plans.lint import lint

    names = _register(spark, a.lake)
    policy = Policy(frozenset(f"gold.{n}" for n in names), a.max_rows, a.timeout)
    safe = validate(spark, a.sql, policy)
    check_cost(analysed(spark, safe), policy)
    got = execute(spark, safe, policy)
    return {"columns": got.columns, "rows": [[plain(c) for c in r] for r in got.rows], "truncated": got.truncated, "findings": lint(spark, safe.sql, {t.name: (t.partitioned_by or "", frozenset(t.columns)) for t in schema.STAR.values()})}


COMMANDS = {"load-dims": load_dims, "load-fact": load_fact, "finalize": finalize, "refresh-rollups": refresh_rollups, "profile": profile, "db-init": db_init, "kb-init": kb_init, "kb-drop": kb_drop, "kb-build": kb_build, "kb-search": kb_search, "docs-fetch": docs_fetch, "docs-parse": docs_parse, "query": query, "ping": ping, "drop": drop, "ask": ask, "eval": evaluate}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quaystone")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = sub.add_parser(name, help=(f.__doc__ or name).strip().splitlines()[0])
        c.add_argument("--lake", required=True, help="folder of the tables")
        if name in ("load-dims", "load-fact"):
            c.add_argument("--export", required=True)
            c.add_argument("--no-manifest", action="store_true", help="the export has none, so nothing is held against it")
        if name == "load-fact":
            c.add_argument("--from", dest="start", type=date.fromisoformat)
            c.add_argument("--to", dest="end", type=date.fromisoformat, help="exclusive")
            c.add_argument("--on-violation", choices=("fail", "skip"), default="fail")
        if name in ("drop", "kb-drop"):
            c.add_argument("--yes", action="store_true")
        if name in ("ask", "eval"):
            c.add_argument("--replies", required=True, help="file of stored replies")
        if name == "ask":
            c.add_argument("question")
        if name == "eval":
            c.add_argument("--cases", required=True)
            c.add_argument("--out", required=True)
        if name.startswith("kb-") or name in ("ask", "eval"):
            c.add_argument("--dimensions", type=int, default=768)
        if name == "kb-build":
            c.add_argument("--corpus", required=True)
        if name == "kb-search":
            c.add_argument("question")
            c.add_argument("--top", type=int, default=4)
            c.add_argument("--floor", type=float, default=0.0)
        if name == "docs-fetch":
            c.add_argument("--registry", required=True)
            c.add_argument("source")
        if name == "docs-parse":
            c.add_argument("blocks")
        if name == "query":
            c.add_argument("sql")
            c.add_argument("--max-rows", type=int, default=200)
            c.add_argument("--timeout", type=float, default=30.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quaystone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(COMMANDS[a.command](spark, a), default=str))
        return 0
    except (ValueError, RuntimeError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
