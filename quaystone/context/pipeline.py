"""Question to SQL to rows to prose, every step guarded and traced."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.context import prompts
from quaystone.evaluation.trace import annotate, span, traced
from quaystone.functions import vectors
from quaystone.functions.text import route as route_expression
from quaystone.operators import rollups
from quaystone.plans.execute import QueryFailed, QueryResult, QueryTooExpensive, check_cost, execute, plain
from quaystone.plans.guard import Policy, SafeQuery, UnsafeQuery, analysed, validate
from quaystone.plans.lint import lint
from quaystone.schema import STAR


class TextGenerator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Unanswered(RuntimeError):
    """The question was not answered; the message may be shown."""


class StaleRollup(RuntimeError):
    """A rollup does not hold what the fact holds."""


@dataclass(frozen=True)
class Answer:
    route: str
    text: str
    sql: str | None = None
    result: QueryResult | None = None
    sources: tuple[tuple[str, str | None], ...] = ()
    findings: tuple[str, ...] = ()


class Canned:
    """A generator that replies from a list, for tests and replays."""

    def __init__(self, replies: Sequence[str]):
        self.replies, self.prompts = list(replies), []

    def __call__(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.replies.pop(0)


class AnswerPipeline:
    """Built once per process: profile, rollup freshness and context are measured here, so that a stale rollup stops the start."""

    def __init__(self, spark: SparkSession, policy: Policy, generate: TextGenerator, chunks: DataFrame | None = None, embedder: Embedder | None = None, top_k: int = 4, floor: float = 0.0, profile: Callable[[], dict] | None = None):
        self.spark, self.policy, self.generate, self.chunks, self.embedder, self.top_k, self.floor = spark, policy, generate, chunks, embedder, top_k, floor
        with traced("startup"):
            with span("profile"):
                self.profile = profile() if profile else rollups.coverage_profile(spark.table(f"{policy.default_schema}.fact_stop_event")).first().asDict()
            with span("rollups"):
                for name in ("agg_station_day", "agg_relation_day"):
                    if f"{policy.default_schema}.{name}" in policy.tables and spark.catalog.tableExists(f"{policy.default_schema}.{name}"):
                        if not rollups.freshness(spark.table(f"{policy.default_schema}.fact_stop_event"), spark.table(f"{policy.default_schema}.{name}")).first().is_fresh:
                            raise StaleRollup(name)
            with span("context"):
                self.system = prompts.context(sorted(policy.tables), self.profile)
        self.tables = {t.name: (t.partitioned_by or "", frozenset(t.columns)) for t in STAR.values()}

    def retrieve(self, question: str, exclude: Sequence[str] = ()) -> list[tuple[str, str | None, str]]:
        if self.chunks is None or self.embedder is None:
            return []
        (q,) = self.embedder.embed([question])
        out = F.col("doc_id").isin(list(exclude)) if exclude else None
        near = vectors.nearest(self.chunks, "embedding", q, self.top_k, ["doc_id", "chunk_index"], out, self.floor)
        return [(r.doc_id, r.heading, r.content) for r in near.where("kept").select("doc_id", "heading", "content").collect()]

    def classify(self, question: str) -> str:
        """By phrases; where they are even the generator decides, and its failure means data."""
        found = self.spark.range(1).select(route_expression(F.lit(question))).first()[0]
        if found:
            return found
        try:
            return "conceptual" if "conceptual" in self.generate(f"Is this a question about data or a conceptual one?\n{question}").lower() else "data"
        except Exception:  # noqa: BLE001
            return "data"

    def _query(self, question: str) -> SafeQuery | None:
        rejection = None
        for _ in range(2):
            with span("sql_generation"):
                sql = prompts.extract_sql(self.generate(prompts.sql_prompt(self.system, question, rejection)))
            if sql is None:
                return None
            try:
                with span("guard"):
                    return validate(self.spark, sql, self.policy)
            except UnsafeQuery as e:
                rejection = str(e)
        raise Unanswered(f"no admissible query: {rejection}")

    def answer(self, question: str, narrate: bool = True) -> Answer:
        if not question.strip() or len(question) > prompts.QUESTION_CHARS:
            raise Unanswered("the question is empty or too long")
        with traced("answer", question):
            with span("retrieve"):
                found = self.retrieve(question)
            sources = tuple((d, h) for d, h, _ in found)
            with span("route"):
                route = self.classify(question)
            annotate(route=route)
            query = None
            if route == "data":
                try:
                    query = self._query(question)
                except ValueError as e:
                    raise Unanswered(str(e)) from e
            if query is None:
                annotate(route="conceptual")
                with span("narrate"):
                    text = self.generate(f"PASSAGES\n{prompts.passages(found)}\n\nQUESTION\n{question}") if found and narrate else prompts.passages(found)
                return Answer("conceptual", text, sources=sources)
            try:
                with span("sql_checks"):
                    findings = lint(self.spark, query.sql, self.tables)
                    cost = check_cost(analysed(self.spark, query), self.policy)
                    annotate(findings=list(findings), partitions=cost.partitions if cost else {})
                with span("execute"):
                    result = execute(self.spark, query, self.policy)
            except (QueryTooExpensive, QueryFailed) as e:
                raise Unanswered(str(e)) from e
            except Exception as e:
                raise Unanswered(type(e).__name__) from e
            with span("narrate"):
                text = self.generate(prompts.answer_prompt(question, result.columns, result.rows)) if narrate else ""
            return Answer("data", text, query.sql, result, sources, findings)

    def health(self) -> dict:
        """Alive: says nothing about the tables."""
        return {"status": "ok"}

    def ask(self, body: dict) -> tuple[int, dict]:
        """(status, answer) of a request ``{"question": text}``: 200, 400 for any other form, 422 if it cannot be answered, 503 for a failure."""
        question = body.get("question") if isinstance(body, dict) and set(body) == {"question"} else None
        if not isinstance(question, str) or not question.strip() or len(question) > prompts.QUESTION_CHARS:
            return 400, {"detail": f"a question of 1 to {prompts.QUESTION_CHARS} characters is wanted, and nothing else"}
        try:
            got = self.answer(question)
        except Unanswered as e:
            return 422, {"detail": str(e)}
        except Exception as e:  # noqa: BLE001
            return 503, {"detail": type(e).__name__}
        rows = [[plain(c) for c in r] for r in got.result.rows] if got.result else None
        return 200, {"route": got.route, "text": got.text, "sql": got.sql, "columns": list(got.result.columns) if got.result else None, "rows": rows, "sources": [list(s) for s in got.sources], "findings": list(got.findings)}

    def ready(self) -> str | None:
        """The first thing that keeps the service from answering, or None."""
        missing = [t for t in sorted(self.policy.tables) if not self.spark.catalog.tableExists(t)]
        return f"missing tables: {', '.join(missing)}" if missing else None if self.profile["fact_rows"] else "there are no facts"
