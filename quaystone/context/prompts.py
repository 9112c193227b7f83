"""Prompts and what is read from replies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from quaystone import schema

NO_SQL = "NO_SQL"
PASSAGE_CHARS, ROWS_SHOWN, QUESTION_CHARS = 2000, 30, 500

RULES = """Rates are SUM(punctual_arrivals)::double / NULLIF(SUM(measured_arrivals), 0), never a mean of ratios.
A null punctual_arrivals means unmeasured. Punctual means under 360 seconds late; delays may be negative.
Station -1 is unresolved: it counts in totals and is left out of rankings by station.
Bound date_key by literals in a half-open range. Use the daily rollups where their columns suffice.
Count trains by COUNT(DISTINCT train_no). Take coverage from the facts, not from dim_date.
Write NULLS LAST and a tiebreak in every ORDER BY."""


def coverage(profile: dict | None) -> str:
    """The measured extent of the facts as text."""
    if not profile or not profile.get("fact_rows"):
        return "COVERAGE: EMPTY, there are no facts."
    lines = [f"COVERAGE: {profile['fact_rows']} rows, {profile['first_day']} to {profile['last_day']}, {profile['days']} days, {profile['stations']} stations."]
    lines += [f"Some {kind}: {', '.join(map(str, profile[f'known_{kind}']))}" for kind in ("stations", "operators", "relations") if profile.get(f"known_{kind}")]
    return "\n".join(lines)


def context(tables: Sequence[str], profile: dict | None) -> str:
    return "\n\n".join(["SCHEMA\n" + schema.render(list(tables)), "RULES\n" + RULES, coverage(profile)])


def passages(found: Sequence[tuple[str, str | None, str]]) -> str:
    return "\n\n".join(f"[{doc}{' / ' + heading if heading else ''}]\n{text[:PASSAGE_CHARS]}" for doc, heading, text in found)


def sql_prompt(system: str, question: str, rejection: str | None = None) -> str:
    again = f"\n\nThe last query was rejected: {rejection}\nWrite another." if rejection else ""
    return f"{system}\n\nQUESTION\n{question}\n\nReply with one Spark SQL SELECT, or {NO_SQL} if the tables cannot answer it.{again}"


def answer_prompt(question: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    head = " | ".join(columns)
    body = "\n".join(" | ".join("" if c is None else str(c) for c in r) for r in rows[:ROWS_SHOWN])
    return f"QUESTION\n{question}\n\nRESULT\n{head}\n{body}\n\nAnswer from this result only."


_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?(.*?)```", re.S)


def extract_sql(reply: str) -> str | None:
    """The SQL of a reply: from its first code fence or the bare text; None for the sentinel; ValueError if there is neither."""
    text = m.group(1) if (m := _FENCE.search(reply)) else reply
    text = text.strip().rstrip(";").strip()
    if text.upper().startswith(NO_SQL):
        return None
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("the reply holds no query")
    return text
