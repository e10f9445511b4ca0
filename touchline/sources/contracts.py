"""Column contracts of the canonical tables: schemas, and the rules that rows must keep, counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS_SCHEMA = "match_id string, period int, time_seconds double, team_id string, player_id string, start_x double, start_y double, end_x double, end_y double, action_type string, result string, bodypart string, raw_event_id string"
TRACKING_SCHEMA = "match_id string, period int, frame_id long, time_seconds double, player_id string, team_id string, x double, y double, is_ball boolean, visible boolean"

# Column, least and greatest value (None: open), whether null is allowed.
ACTION_RULES = (
    ("match_id", None, None, False), ("period", 1, 5, False), ("time_seconds", 0.0, None, False), ("team_id", None, None, False), ("start_x", 0.0, 105.0, True), ("start_y", 0.0, 68.0, True),
    ("end_x", 0.0, 105.0, True), ("end_y", 0.0, 68.0, True), ("action_type", None, None, False), ("raw_event_id", None, None, False),
)
TRACKING_RULES = (
    ("match_id", None, None, False), ("period", 1, 5, False), ("frame_id", 0, None, False), ("time_seconds", 0.0, None, False), ("x", -15.0, 120.0, True), ("y", -15.0, 83.0, True), ("is_ball", None, None, False), ("visible", None, None, False),
)


def broken(rules: tuple) -> dict[tuple[str, str], Column]:
    """(column, rule) to the condition that breaks it."""
    out = {}
    for name, low, high, nullable in rules:
        c = F.col(name)
        if not nullable:
            out[name, "null"] = c.isNull()
        bounds = [c < low] * (low is not None) + [c > high] * (high is not None)
        if bounds:
            out[name, "range"] = F.coalesce(bounds[0] | bounds[-1], F.lit(False))
    return out


def violation_counts(rows: DataFrame, rules: tuple) -> DataFrame:
    """(column_name, rule, n) of the rules that rows break; one aggregate over the table, whatever the number of rules."""
    conditions = broken(rules)
    counts = rows.agg(*[F.count_if(c).alias(f"{name}|{rule}") for (name, rule), c in conditions.items()])
    long = counts.unpivot([], [F.col(f"`{name}|{rule}`") for name, rule in conditions], "key", "n").filter("n > 0")
    part = F.split("key", r"\|")
    return long.select(part[0].alias("column_name"), part[1].alias("rule"), "n")


def violations(rows: DataFrame, rules: tuple) -> DataFrame:
    """The rows that break rules, with the array broken ('column:rule')."""
    said = F.array(*[F.when(c, F.lit(f"{name}:{rule}")) for (name, rule), c in broken(rules).items()])
    return rows.withColumn("broken", F.array_compact(said)).filter(F.size("broken") > 0)


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """The schema's columns only, cast to its types."""
    return rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", ")])
