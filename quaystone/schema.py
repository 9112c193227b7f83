"""Declared schemas of the star: types, keys, rules and comments, from which scans, contracts and prompts are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, SHORT, INT, LONG, DOUBLE, BOOL, TEXT, TIME = T.DateType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.TimestampType()
UNRESOLVED = -1


@dataclass(frozen=True)
class Table:
    """A table of the star: columns in order, its grain, references to other tables and value rules."""

    name: str
    comment: str
    columns: dict[str, tuple[T.DataType, bool, str]]
    grain: tuple[str, ...]
    references: dict[str, str] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    partitioned_by: str | None = None

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, nullable, {"comment": c}) for n, (t, nullable, c) in self.columns.items()])

    def broken(self) -> dict[str, Column]:
        """Per rule, the condition under which a row breaks it; a null value breaks no value rule."""
        checks = {f"{c}_required": F.col(c).isNull() for c, (_, nullable, _) in self.columns.items() if not nullable}
        return checks | {name: F.coalesce(~F.expr(text), F.lit(False)) for name, text in self.rules.items()}


DIM_DATE = Table(
    "dim_date",
    "Calendar, far wider than the facts: take coverage from the facts.",
    {
        "date_key": (DATE, False, "day"),
        "year": (SHORT, False, "calendar year"),
        "quarter": (SHORT, False, "1 to 4"),
        "month": (SHORT, False, "1 to 12"),
        "month_name": (TEXT, False, "English month name"),
        "week_of_year": (SHORT, False, "ISO week"),
        "day_of_week": (SHORT, False, "1 is Sunday"),
        "day_name": (TEXT, False, "English day name"),
        "is_weekend": (BOOL, False, "Saturday or Sunday"),
    },
    ("date_key",),
    rules={"quarter_range": "quarter BETWEEN 1 AND 4", "month_range": "month BETWEEN 1 AND 12", "week_range": "week_of_year BETWEEN 1 AND 53", "day_range": "day_of_week BETWEEN 1 AND 7"},
)
DIM_STATION = Table(
    "dim_station",
    "Stations; key -1 stands for every stop whose station is unresolved.",
    {
        "station_key": (INT, False, "surrogate key"),
        "station_name": (TEXT, False, "name as registered"),
        "ptcar_no": (INT, True, "infrastructure number"),
        "observed_stop_events": (INT, True, "stop events in the fact, 0 without any"),
        "first_seen": (DATE, True, "first day seen"),
        "last_seen": (DATE, True, "last day seen"),
        "station_type": (TEXT, True, "kind of point"),
        "is_passenger": (BOOL, False, "serves passengers"),
        "latitude": (DOUBLE, True, "WGS84"),
        "longitude": (DOUBLE, True, "WGS84"),
    },
    ("station_key",),
    rules={"station_key_range": f"station_key >= {UNRESOLVED}"},
)
DIM_RELATION = Table(
    "dim_relation",
    "Train relations; the key is the MD5 of relation, direction and operator joined by a bar, nulls skipped.",
    {"relation_key": (TEXT, False, "MD5 in hex"), "relation": (TEXT, True, "line name"), "relation_direction": (TEXT, True, "line and direction"), "operator": (TEXT, True, "operating company")},
    ("relation_key",),
    rules={"relation_key_length": "length(relation_key) = 32"},
)
_EXPORT = {
    "date_key": (DATE, False, "day of operation"),
    "station_key": (INT, False, "station"),
    "stop_point_key": (TEXT, False, "stop point; a station may own several"),
    "relation_key": (TEXT, False, "relation"),
    "train_no": (INT, False, "train number"),
    "planned_hour": (SHORT, True, "hour of the planned arrival"),
    "delay_arr_s": (INT, True, "arrival delay in seconds, negative if early"),
    "delay_dep_s": (INT, True, "departure delay in seconds"),
    "dwell_delta_s": (INT, True, "change of delay during the stop"),
    "punctual_arrivals": (SHORT, True, "1 if under 360 s late, 0 if not, null if unmeasured"),
    "stop_events": (SHORT, False, "stop events of the row"),
}
_FACT_RULES = {
    "hour_range": "planned_hour BETWEEN 0 AND 23",
    "punctual_range": "punctual_arrivals BETWEEN 0 AND 1",
    "stop_events_range": "stop_events >= 0",
    "stop_point_key_length": "length(stop_point_key) = 32",
    "relation_key_length": "length(relation_key) = 32",
}
_STAR = {"date_key": "dim_date", "station_key": "dim_station", "relation_key": "dim_relation"}
GRAIN = ("date_key", "stop_point_key", "train_no")
KEYS = ("date_key", "station_key", "stop_point_key", "relation_key", "train_no")
EXPORT = Table("fact_export", "Facts as exported.", _EXPORT, GRAIN, _STAR, _FACT_RULES, "date_key")
FACT = Table(
    "fact_stop_event",
    "One row per day, stop point and train.",
    _EXPORT | {"measured_arrivals": (SHORT, False, "0 if punctual_arrivals is null, else 1")},
    GRAIN,
    _STAR,
    _FACT_RULES | {"measured_follows_punctual": "measured_arrivals = IF(punctual_arrivals IS NULL, 0, 1)"},
    "date_key",
)
_SUMS = {"row_count": (LONG, False, "fact rows"), "stop_events": (LONG, False, "sum"), "measured_arrivals": (LONG, False, "sum"), "punctual_arrivals": (LONG, False, "sum, 0 if none was measured")}
AGG_STATION = Table("agg_station_day", "Exact daily sums per station.", {"date_key": (DATE, False, "day"), "station_key": (INT, False, "station")} | _SUMS, ("date_key", "station_key"), {"date_key": "dim_date", "station_key": "dim_station"})
AGG_RELATION = Table("agg_relation_day", "Exact daily sums per relation.", {"date_key": (DATE, False, "day"), "relation_key": (TEXT, False, "relation")} | _SUMS, ("date_key", "relation_key"), {"date_key": "dim_date", "relation_key": "dim_relation"})
STAR = {t.name: t for t in (DIM_DATE, DIM_STATION, DIM_RELATION, FACT, AGG_STATION, AGG_RELATION)}

_SQL_NAMES = {DATE: "DATE", SHORT: "SMALLINT", INT: "INTEGER", LONG: "BIGINT", DOUBLE: "DOUBLE PRECISION", BOOL: "BOOLEAN", TEXT: "TEXT", TIME: "TIMESTAMP"}


def render(tables: list[str]) -> str:
    """The definitions of the named tables as text for a prompt; an unknown name is an error."""
    out = []
    for name in tables:
        short = name.rpartition(".")[2]
        if short not in STAR:
            raise KeyError(f"no such table: {name}")
        t = STAR[short]
        lines = [f"  {n} {_SQL_NAMES[k]}{'' if nullable else ' NOT NULL'},  -- {c}" for n, (k, nullable, c) in t.columns.items()]
        lines.append(f"  PRIMARY KEY ({', '.join(t.grain)})")
        lines += [f"  CHECK ({rule})" for rule in t.rules.values()]
        lines += [f"  FOREIGN KEY ({c}) REFERENCES gold.{parent}" for c, parent in t.references.items()]
        out.append(f"-- {t.comment}\nTABLE gold.{t.name} (\n" + "\n".join(lines) + "\n)")
    return "\n\n".join(out)
