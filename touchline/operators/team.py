"""Team metrics from actions: pressing, tilt, profiles and their scores, pass networks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as G

# Pressing actions, the pressing zone, the cap of an infinite PPDA, metric polarity, thresholds of the network.
PRESSING, ZONE, PPDA_CAP, THIRD = ("tackle", "interception", "foul", "block", "clearance"), 0.4, 50.0, 2 / 3
HIGHER = ("xt_generated", "field_tilt", "shots", "goals", "off_line_mean", "hull_area_mean")
LOWER = ("ppda", "xt_conceded", "vertical_compactness_mean")
NEUTRAL = ("length_mean", "width_mean", "def_line_mean")
TOUCHES, FULL_TEAM, TOP_TOUCHES, EDGE = 10, 11, 14, 3
# Lower-case particles that belong to the family name that follows.
PARTICLES = ("di", "de", "del", "della", "la", "le", "van", "von", "da", "das", "do", "dos", "mc", "mac", "al", "el", "bin", "ben", "ter", "ten")


def _zone_counts(events: DataFrame) -> DataFrame:
    """Per match and team: passes and pressing actions in the zone, passes in the last third, shots, goals, actions."""
    zone, third = F.col("start_x") < ZONE * G.LENGTH, F.col("start_x") >= THIRD * G.LENGTH
    passes, shot = F.col("action_type") == "pass", F.col("action_type") == "shot"
    return events.groupBy("match_id", "team_id").agg(
        F.count_if(passes & zone).alias("zone_passes"), F.count_if(F.col("action_type").isin(*PRESSING) & zone).alias("presses"), F.count_if(passes & third).alias("third_passes"),
        F.count_if(passes).alias("passes"), F.count_if(shot).alias("shots"), F.count_if(shot & (F.col("result") == "success")).alias("goals"), F.count("*").alias("actions"),
    )


def _with_opponent(counts: DataFrame) -> DataFrame:
    """Each pair of teams of a match; the aggregated rows are few, so this join is small."""
    other = counts.select("match_id", *[F.col(c).alias(f"opp_{c}") for c in counts.columns if c != "match_id"])
    return counts.join(other, "match_id").filter(F.col("team_id") != F.col("opp_team_id"))


def pressing(events: DataFrame) -> DataFrame:
    """PPDA and field tilt per match, team and opponent. ppda is null where the team has no pressing action (infinite)."""
    both = _with_opponent(_zone_counts(events))
    tilt = F.coalesce(F.try_divide(F.col("third_passes").cast("double"), F.col("third_passes") + F.col("opp_third_passes")), F.lit(0.0))
    return both.select("match_id", "team_id", F.col("opp_team_id").alias("opponent_id"), F.try_divide(F.col("opp_zone_passes").cast("double"), F.col("presses")).alias("ppda"), tilt.alias("field_tilt"))


def profiles(valued: DataFrame) -> DataFrame:
    """Per match and team: xt_generated, xt_conceded, ppda (infinite: PPDA_CAP), field_tilt, shots, goals, n. Needs xt_delta."""
    counts = _zone_counts(valued).join(valued.groupBy("match_id", "team_id").agg(F.sum(F.greatest(F.coalesce("xt_delta", F.lit(0.0)), F.lit(0.0))).alias("xt_generated")), ["match_id", "team_id"])
    both = _with_opponent(counts)
    tilt = F.coalesce(F.try_divide(F.col("third_passes").cast("double"), F.col("third_passes") + F.col("opp_third_passes")), F.lit(0.0))
    return both.select(
        "match_id", "team_id", "xt_generated", F.col("opp_xt_generated").alias("xt_conceded"), F.coalesce(F.try_divide(F.col("opp_zone_passes").cast("double"), F.col("presses")), F.lit(PPDA_CAP)).alias("ppda"),
        tilt.alias("field_tilt"), F.col("shots").cast("double").alias("shots"), F.col("goals").cast("double").alias("goals"), F.col("actions").alias("n"),
    )


METRICS = ("xt_generated", "xt_conceded", "ppda", "field_tilt", "shots", "goals")


def long_profiles(wide: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return wide.unpivot(["match_id", "team_id"], list(metrics), "metric", "value").filter("value is not null")


def baseline(profile_rows: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric (0 for one row)."""
    return profile_rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def scores(profile_rows: DataFrame, base: DataFrame, limit: float = 0.5) -> DataFrame:
    """z, adjusted_z (sign turned where lower is better) and verdict of each value against the baseline."""
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    rows = profile_rows.join(F.broadcast(base), "metric").withColumn("z", z)  # a row per metric
    rows = rows.withColumn("adjusted_z", F.when(F.col("metric").isin(*LOWER), -F.col("z")).otherwise(F.col("z")))
    verdict = F.when(F.col("metric").isin(*NEUTRAL), "neutral").when(F.col("adjusted_z") >= limit, "strength").when(F.col("adjusted_z") <= -limit, "weakness").otherwise("neutral")
    return rows.select("match_id", "team_id", "metric", "value", "z", "adjusted_z", verdict.alias("verdict"))


def verdict_lists(scored: DataFrame) -> DataFrame:
    """Per match and team: strengths, weaknesses and neutral, the metrics of each verdict in the alphabet's order (scores' rows)."""
    of = lambda v: F.sort_array(F.collect_set(F.when(F.col("verdict") == v, F.col("metric"))))
    return scored.groupBy("match_id", "team_id").agg(of("strength").alias("strengths"), of("weakness").alias("weaknesses"), of("neutral").alias("neutral"))


def radar(scored: DataFrame, clip: float = 3.0) -> DataFrame:
    """A row per match and team with each metric's adjusted_z, held within clip; null where the team lacks the metric."""
    held = F.greatest(F.least("adjusted_z", F.lit(clip)), F.lit(-clip))
    return scored.groupBy("match_id", "team_id").pivot("metric", sorted(METRICS)).agg(F.first(held))


def overview(valued: DataFrame) -> DataFrame:
    """team_summary with the team's ppda and field_tilt."""
    return team_summary(valued).join(pressing(valued).select("match_id", "team_id", "ppda", "field_tilt"), ["match_id", "team_id"], "left")


def label_ranks(nodes: DataFrame) -> DataFrame:
    """The nodes of a pass network with y_rank, from 1 by y (ties to the smaller id), by whose parity labels go above or below."""
    return nodes.withColumn("y_rank", F.row_number().over(Window.partitionBy("match_id", "team_id").orderBy("y", "player_id")))  # a team's players


def team_summary(valued: DataFrame) -> DataFrame:
    """passes, shots, goals, xt per match and team."""
    return valued.groupBy("match_id", "team_id").agg(
        F.count_if(F.col("action_type") == "pass").alias("passes"), F.count_if(F.col("action_type") == "shot").alias("shots"),
        F.count_if((F.col("action_type") == "shot") & (F.col("result") == "success")).alias("goals"), F.sum("xt_delta").alias("xt"),
    )


def top_players(valued: DataFrame, k: int = 10) -> DataFrame:
    """The k players of each match with the highest sum of positive xt_delta; ties go to the smaller id."""
    sums = valued.filter("xt_delta > 0 and player_id is not null").groupBy("match_id", "player_id").agg(F.round(F.sum("xt_delta"), 3).alias("xt"), F.count("*").alias("n"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("xt"), "player_id"))).filter(F.col("rank") <= k)


def match_scores(events: DataFrame) -> DataFrame:
    """Goals per side; period 5 (the shoot-out) doesn't count."""
    goal = (F.col("action_type") == "shot") & (F.col("result") == "success") & (F.col("period") != 5)
    return events.groupBy("match_id").agg(F.count_if(goal & (F.col("team_id") == "home")).alias("home_goals"), F.count_if(goal & (F.col("team_id") == "away")).alias("away_goals"))


def action_map(events: DataFrame) -> DataFrame:
    """Counts for an action map: moves with an end, shots, goals, defensive actions."""
    return events.groupBy("match_id", "team_id").agg(
        F.count_if(F.col("action_type").isin("pass", "dribble") & F.col("end_x").isNotNull()).alias("moves"), F.count_if(F.col("action_type") == "shot").alias("shots"),
        F.count_if((F.col("action_type") == "shot") & (F.col("result") == "success")).alias("goals"), F.count_if(F.col("action_type").isin("interception", "clearance", "tackle", "foul")).alias("defensive"),
    )


def network_nodes(events: DataFrame) -> DataFrame:
    """Players of a pass network: at least TOUCHES touches, or the TOP_TOUCHES of a team that has fewer than FULL_TEAM such players."""
    nodes = events.filter("player_id is not null").groupBy("match_id", "team_id", "player_id").agg(F.count("*").alias("touches"), F.avg("start_x").alias("x"), F.avg("start_y").alias("y"))
    team = Window.partitionBy("match_id", "team_id")
    ranked = nodes.withColumns({"busy_": F.count_if(F.col("touches") >= TOUCHES).over(team), "place_": F.row_number().over(team.orderBy(F.desc("touches"), "player_id"))})
    return ranked.filter(F.when(F.col("busy_") >= FULL_TEAM, F.col("touches") >= TOUCHES).otherwise(F.col("place_") <= TOP_TOUCHES)).drop("busy_", "place_")


def network_edges(events: DataFrame, least: int = EDGE) -> DataFrame:
    """Successful passes between two players of the network; the receiver is the player of the team's next action."""
    w = Window.partitionBy("match_id", "team_id").orderBy("period", "time_seconds", "seq")
    passes = events.withColumn("receiver_id", F.lead("player_id").over(w)).filter("action_type = 'pass' and result = 'success' and player_id <> receiver_id")
    keys = network_nodes(events).select("match_id", "team_id", "player_id")
    edges = passes.groupBy("match_id", "team_id", "player_id", "receiver_id").agg(F.count("*").alias("passes")).filter(F.col("passes") >= least)
    return edges.join(keys, ["match_id", "team_id", "player_id"], "left_semi").join(keys.withColumnRenamed("player_id", "receiver_id"), ["match_id", "team_id", "receiver_id"], "left_semi")


def short_name(name):
    """The last word of a name, with a particle (dots at its end don't count) before it, at most 14 characters; a name without words as it is."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    last, before = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    particle = F.regexp_replace(F.lower(before), r"\.+$", "").isin(*PARTICLES)
    return F.substring(F.when(particle, F.concat_ws(" ", before, last)).otherwise(F.coalesce(last, name)), 1, 14)


def clock_text(period, seconds):
    """P1  03:05.20"""
    return F.format_string("P%d  %02d:%05.2f", period.cast("int"), F.floor(seconds / 60).cast("int"), seconds - F.floor(seconds / 60) * 60)


def player_positions(events: DataFrame) -> DataFrame:
    """Per player: n actions with a start, mean start, and the team of most of them (ties to the smaller id). Rows without a player or start go."""
    own = events.select("player_id", "team_id", G.clean(F.col("start_x")).alias("x"), G.clean(F.col("start_y")).alias("y")).dropna(subset=["player_id", "x", "y"])
    return own.groupBy("player_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.mode("team_id", True).alias("team_id"))
