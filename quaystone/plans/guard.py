"""Read-only SQL: admitted by what Spark's own parser makes of it, never by its text."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes a query may consist of before analysis. Everything else is refused, known or not: commands, writes, table functions.
ALLOWED_NODES = frozenset(
    "LimitAll Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedHaving OneRowRelation WithWindowDefinition "
    "UnresolvedInlineTable LocalRelation Except Intersect LateralJoin Pivot Unpivot Window Expand UnresolvedOrdinal CTERelationRef CTERelationDef WithCTE Tail UnresolvedTableAliases UnresolvedStarWithColumns".split()
)
ROOTS_REFUSED = frozenset({"Except", "Intersect", "UnresolvedInlineTable", "LocalRelation"})


class UnsafeQuery(ValueError):
    """A statement that may not run; the message says why."""


@dataclass(frozen=True)
class Policy:
    """What may be read and how much may come back."""

    tables: frozenset[str]
    max_rows: int = 200
    timeout_s: float = 30.0
    max_scan_bytes: int | None = None
    default_schema: str = "gold"
    #: Functions that reach outside the data; by name, at any depth.
    blocked_functions: frozenset[str] = frozenset({"reflect", "java_method", "try_reflect", "raise_error", "input_file_name", "input_file_block_start", "input_file_block_length", "assert_true", "current_user", "session_user", "user", "version", "sleep", "ai_query", "http_request", "read_files"})


@dataclass(frozen=True)
class SafeQuery:
    sql: str
    limit: int
    tables: frozenset[str]
    #: Where names without a schema are looked up, as they were when the query was admitted.
    schema: str = "gold"


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def plan_nodes(plan) -> Iterator:
    """Every plan node, also those inside expressions (subqueries) and inside CTE definitions."""
    yield plan
    kids = _seq(plan.children().toSeq())
    name = plan.getClass().getSimpleName()
    if name == "UnresolvedWith":
        for pair in _seq(plan.cteRelations().toSeq()):
            yield from plan_nodes(pair._2() if hasattr(pair, "_2") else pair)
    if name == "WithCTE":
        for d in _seq(plan.cteDefs().toSeq()):
            yield from plan_nodes(d)
    for child in kids:
        yield from plan_nodes(child)
    for e in _seq(plan.expressions().toSeq()):
        for x in expression_nodes(e):
            if x.getClass().getSimpleName() in SUBQUERIES:
                yield from plan_nodes(x.plan())


SUBQUERIES = frozenset({"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "DynamicPruningSubquery", "FunctionTableSubqueryArgumentExpression"})


def expression_nodes(e) -> Iterator:
    yield e
    for child in _seq(e.children().toSeq()):
        yield from expression_nodes(child)


def _cte_names(plan) -> set[str]:
    out = set()
    for node in plan_nodes(plan):
        if node.getClass().getSimpleName() == "UnresolvedWith":
            out |= {pair._1().lower() for pair in _seq(node.cteRelations().toSeq())}
    return out


def parse(spark: SparkSession, sql: str):
    if not sql or not sql.strip():
        raise UnsafeQuery("the query is empty")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise UnsafeQuery(f"the query does not parse: {e.getCondition()}") from e


def validate(spark: SparkSession, sql: str, policy: Policy) -> SafeQuery:
    """The query's tables if it may run, else UnsafeQuery. A trailing semicolon is taken off; two statements do not parse."""
    text = sql.strip().rstrip(";").strip() if sql else ""
    plan = parse(spark, text)
    root = plan
    while root.getClass().getSimpleName() in ("UnresolvedWith", "GlobalLimit", "LocalLimit", "LimitAll", "Sort", "SubqueryAlias"):
        root = root.child()
    if root.getClass().getSimpleName() in ROOTS_REFUSED:
        raise UnsafeQuery(f"{root.getClass().getSimpleName()} is not allowed as the query itself")
    ctes, tables = _cte_names(plan), set()
    for node in plan_nodes(plan):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED_NODES:
            raise UnsafeQuery(f"{name} is not allowed in a query")
        if name == "UnresolvedRelation":
            parts = [p.lower() for p in _seq(node.multipartIdentifier().toSeq())]
            if len(parts) == 1 and parts[0] in ctes:
                continue
            tables.add(".".join(parts) if len(parts) > 1 else f"{policy.default_schema}.{parts[0]}")
        for e in _seq(node.expressions().toSeq()):
            for x in expression_nodes(e):
                if x.getClass().getSimpleName() == "UnresolvedAttribute":
                    # A bare name that is no column may be a function without brackets.
                    parts = [p.lower() for p in _seq(x.nameParts().toSeq())]
                    if len(parts) == 1 and parts[0] in policy.blocked_functions:
                        raise UnsafeQuery(f"function {parts[0]} is not allowed")
                if x.getClass().getSimpleName() == "UnresolvedFunction":
                    called = _seq(x.nameParts().toSeq())[-1].lower()
                    if called in policy.blocked_functions:
                        raise UnsafeQuery(f"function {called} is not allowed")
                    if called not in _builtin(spark):
                        raise UnsafeQuery(f"function {called} is unknown")
    unknown = sorted(tables - {t.lower() for t in policy.tables})
    if unknown:
        raise UnsafeQuery(f"tables not allowed: {', '.join(unknown)}")
    return SafeQuery(text, policy.max_rows, frozenset(tables), policy.default_schema)


_known: dict[int, frozenset[str]] = {}


def _builtin(spark: SparkSession) -> frozenset[str]:
    key = id(spark)
    if key not in _known:
        _known[key] = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) | {"count", "coalesce", "nullif", "extract", "date_part", "position", "trim", "substring", "overlay", "ceil", "floor", "timestampadd", "timestampdiff"}
    return _known[key]


def capped(spark: SparkSession, query: SafeQuery) -> DataFrame:
    """The query's result under the row cap: added where there is no limit, tightened where it is larger, kept where it is smaller."""
    return analysed(spark, query).limit(query.limit)


_looking_up = threading.Lock()


def analysed(spark: SparkSession, query: SafeQuery) -> DataFrame:
    """The query with its names resolved; analysis is over when this returns, so the session's own schema is back then."""
    with _looking_up:
        now = spark.catalog.currentDatabase()
        if spark.catalog.databaseExists(query.schema):
            spark.catalog.setCurrentDatabase(query.schema)
        try:
            return spark.sql(query.sql)
        finally:
            spark.catalog.setCurrentDatabase(now)
