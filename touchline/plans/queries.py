"""Registered queries over the test tables, with DuckDB SQL for the same rows.

The SQL is built from common table expressions, each written on its own, so that it checks the operators rather than
repeats them. Float results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.operators import corpus_clusters as corpus
from touchline.operators import credit, retrieval, roles, similarity, surfaces, team, tracking, values
from touchline.plans import fixtures
from touchline.sources import contracts

DIGITS = 6
SWEEPS = 80


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0)."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.frames(tracking.velocities(fixtures.tracking(spark, sf_dir)))


def _classified_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame and visible ball."""
    return tracking.classify(tracking.frames(tracking.velocities(fixtures.tracking(spark, sf_dir)), every_ball=True))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.classify(_moving(spark, sf_dir))


def _in_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.episode_frames(_classified(spark, sf_dir))


def _run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame, visible ball and episode of its run."""
    return tracking.run_frames(_classified_balls(spark, sf_dir))


def _ball_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.snapshots(_run_frames(spark, sf_dir))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.spadl(spark, sf_dir)
    return values.apply_xt(events, values.fit_xt(events, max_sweeps=SWEEPS, tolerance=0.0))


# -- actions -----------------------------------------------------------------------------------------------------------


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.spadl(spark, sf_dir)


def xt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.xt_counts(fixtures.spadl(spark, sf_dir))


def xt_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.xt_transitions(fixtures.spadl(spark, sf_dir))


def xt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values.fit_xt(fixtures.spadl(spark, sf_dir), max_sweeps=SWEEPS, tolerance=0.0))


def xt_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_valued(spark, sf_dir).select("match_id", "seq", "xt", "xt_delta"))


def vaep_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.vaep_labels(fixtures.spadl(spark, sf_dir)).select("match_id", "seq", "scores", "concedes")


def vaep_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values.vaep_features(fixtures.spadl(spark, sf_dir)))


def vaep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.spadl(spark, sf_dir)
    return values.score_vaep(events, values.fit_vaep(events))


def running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.value_change(fixtures.spadl(spark, sf_dir))


def pressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.pressing(fixtures.spadl(spark, sf_dir)))


def team_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.profiles(_valued(spark, sf_dir)))


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = team.long_profiles(team.profiles(_valued(spark, sf_dir)))
    return rounded(team.scores(rows, team.baseline(rows)), 5)


def team_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.team_summary(_valued(spark, sf_dir)))


def verdict_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's strengths and weaknesses, as texts."""
    rows = team.long_profiles(team.profiles(_valued(spark, sf_dir)))
    found = team.verdict_lists(team.scores(rows, team.baseline(rows)))
    return found.select("match_id", "team_id", *[F.array_join(c, ",").alias(c) for c in ("strengths", "weaknesses", "neutral")])


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = team.long_profiles(team.profiles(_valued(spark, sf_dir)))
    return rounded(team.radar(team.scores(rows, team.baseline(rows)), 1.5), 5)


def match_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.overview(_valued(spark, sf_dir)))


def network_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.label_ranks(team.network_nodes(fixtures.spadl(spark, sf_dir))).select("match_id", "team_id", "player_id", "y_rank")


def top_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.top_players(_valued(spark, sf_dir))


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.match_scores(fixtures.spadl(spark, sf_dir))


def action_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.action_map(fixtures.spadl(spark, sf_dir))


def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a nation, a particle of its number and a region."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    words = F.array(*[F.lit(x) for x in ("van", "De", "mc.", "of", "TER", "")])
    name = F.concat(F.lit(" "), F.col("n_name"), F.lit(" "), F.element_at(words, F.pmod("n_nationkey", F.lit(6)).cast("int") + 1), F.lit("  "), F.col("r_name"))
    rows = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return rows.select("n_nationkey", team.short_name(name).alias("short"))


def geometry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider points of three origins in metres, mirrored by period, and whether they are on the pitch; clock texts."""
    rows = fixtures.spadl(spark, sf_dir)
    u, v = F.col("start_x") - 3, F.col("start_y") + 2
    out = {}
    for origin, (x, y) in {"bottom_left": (u, v), "top_left": (u, v), "center": (u - 60, v - 40)}.items():
        a, b = G.rescale(x, y, 120.0, 80.0, origin)
        out |= {f"{origin}_x": a, f"{origin}_y": b}
    x, y = G.normalise(u, v, F.col("period"), F.lit(True))
    return rounded(rows.select("seq", *[c.alias(k) for k, c in out.items()], x.alias("norm_x"), y.alias("norm_y"), G.in_bounds(x, y).alias("inside"), team.clock_text(F.col("period"), F.col("time_seconds")).alias("clock")))


def action_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many actions break each rule of the actions schema, some of them spoilt on purpose."""
    rows = fixtures.spadl(spark, sf_dir).withColumns({"start_x": F.when(F.col("seq") % 11 == 0, F.lit(110.5)).otherwise(F.col("start_x")), "team_id": F.when(F.col("seq") % 13 != 0, F.col("team_id")), "period": F.when(F.col("seq") % 17 == 0, 6).otherwise(F.col("period")), "raw_event_id": F.col("seq").cast("string")})
    return contracts.violation_counts(rows, contracts.ACTION_RULES)


def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.network_nodes(fixtures.spadl(spark, sf_dir)))


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.network_edges(fixtures.spadl(spark, sf_dir))


# -- tracking ----------------------------------------------------------------------------------------------------------


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.velocities(fixtures.tracking(spark, sf_dir)).select("match_id", "period", "frame_id", F.coalesce("player_id", F.lit("BALL")).alias("who"), "vx", "vy", "speed"))


def possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.smoothed_possession(tracking.frames(fixtures.tracking(spark, sf_dir), every_ball=True)).select(*tracking.FRAME, "raw_team", "possession_team")


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified_balls(spark, sf_dir).select(*tracking.FRAME, "possession_team", "phase")


def phase_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.phase_segments(_classified_balls(spark, sf_dir)))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.run_episodes(_run_frames(spark, sf_dir)))


def episode_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _run_frames(spark, sf_dir)
    return rounded(tracking.outcomes(frames, tracking.run_episodes(frames)))


def dominant_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.dominant_phases(_run_frames(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ball_snapshots(spark, sf_dir).select(*tracking.MATCH, "episode_id", "frame_id").distinct()


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.ball_states(_ball_snapshots(spark, sf_dir)))


def episode_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _run_frames(spark, sf_dir)
    return rounded(tracking.embeddings(tracking.ball_states(tracking.snapshots(frames)), tracking.dominant_phases(frames)))


def team_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.shape(tracking.frames(fixtures.tracking(spark, sf_dir))))


def obso_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surfaces.ball_trajectory(_ball_snapshots(spark, sf_dir)))


def decisive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surfaces.decisive(surfaces.ball_trajectory(_ball_snapshots(spark, sf_dir))))


def player_obso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surfaces.player_obso(surfaces.different_balls(_ball_snapshots(spark, sf_dir))))


def formation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _classified(spark, sf_dir)
    return rounded(roles.formation_pairs(tracking.episodes(frames), frames), 4)


def role_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roles.role_trajectory(_in_episode(spark, sf_dir)), 4)


def tracking_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _classified(spark, sf_dir)
    return rounded(roles.tracking_profile(tracking.shape(frames), frames), 4)


def episode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _run_frames(spark, sf_dir)
    found = tracking.outcomes(frames, tracking.run_episodes(frames))
    return rounded(found.select(*tracking.MATCH, "episode_id", retrieval.outcome_value().alias("value")))


def player_heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.spadl(spark, sf_dir).select("player_id", F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    return rounded(surfaces.density(events, ["player_id"]), 9)


def player_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(team.player_positions(fixtures.spadl(spark, sf_dir)))


def attack_end_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how the episode ended; the small densities are left out."""
    return rounded(surfaces.density(surfaces.attack_ends(tracking.ends(_run_frames(spark, sf_dir))), ["end_reason"], 130, 200, share=0.05), 9)


def episode_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _run_frames(spark, sf_dir)
    rows, snaps = tracking.run_episodes(frames), tracking.snapshots(frames)
    threat = surfaces.decisive(surfaces.ball_trajectory(snaps))
    return rounded(tracking.summary(rows, tracking.outcomes(frames, rows), tracking.dominant_phases(frames), threat, snaps.select(*credit.EPISODE, "frame_id").distinct()))


def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.phase_totals(tracking.phase_runs(_classified_balls(spark, sf_dir))))


def episode_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit.trigger_frames(tracking.ball_states(_ball_snapshots(spark, sf_dir))))


def shot_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit.ball_strikes(_run_frames(spark, sf_dir)))


def ball_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit.holders(tracking.numbers(fixtures.tracking(spark, sf_dir))))


def smoothed_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.smoothed_holders(tracking.numbers(fixtures.tracking(spark, sf_dir)))


def mean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit.ball_mean_positions(_run_frames(spark, sf_dir)))


def td_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit.ball_td_credit(surfaces.with_ball_peak(_ball_snapshots(spark, sf_dir))))


def _peaks(tagged: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    return credit.peak_frames(rows, found, tracking.states(tracking.snapshots(tagged)))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _classified(spark, sf_dir)
    tagged, rows = tracking.episode_frames(frames), tracking.episodes(frames)
    return rounded(credit.leave_one_out(tagged, _peaks(tagged, rows, tracking.outcomes(tagged, rows))))


def episode_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _classified(spark, sf_dir)
    tagged, rows = tracking.episode_frames(frames), tracking.episodes(frames)
    found = tracking.outcomes(tagged, rows)
    triggers = credit.trigger_frames(tracking.states(tracking.snapshots(tagged)))
    return credit.narratives(rows, found, triggers, credit.leave_one_out(tagged, _peaks(tagged, rows, found)))


def extended_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _in_episode(spark, sf_dir)
    snaps = tracking.snapshots(tagged)
    base = tracking.embeddings(tracking.states(snaps), tracking.dominant_phases(tagged))
    return rounded(tracking.extended_embeddings(base, tracking.pressing_features(snaps, roles.role_trajectory(tagged))), 4)


def defence_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the formation most attackers of the fixture stand in."""
    frames = _classified(spark, sf_dir)
    rows = tracking.episodes(frames)
    return retrieval.recommend_defence(tracking.outcomes(tracking.episode_frames(frames), rows), roles.formation_pairs(rows, frames), "4-3-3")


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each match, by fused distances of extended embeddings and role paths."""
    key = list(credit.EPISODE)
    tagged = _in_episode(spark, sf_dir)
    snaps, played = tracking.snapshots(tagged), roles.role_trajectory(tagged)
    rows = tracking.extended_embeddings(tracking.embeddings(tracking.states(snaps), tracking.dominant_phases(tagged)), tracking.pressing_features(snaps, played))
    vectors = retrieval.scaled(rows, [c for c in rows.columns if c not in key], key)
    pairs = similarity.episode_pairs(vectors, similarity.sequences(played, key), ["match_id"], key)
    return similarity.density_clusters(similarity.fused(pairs, ["match_id"]), ["match_id"], key)


def corpus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of all matches together, by their scaled embeddings."""
    key = list(credit.EPISODE)
    frames = _in_episode(spark, sf_dir)
    rows = tracking.embeddings(tracking.states(tracking.snapshots(frames)), tracking.dominant_phases(frames))
    return corpus.cluster_corpus(retrieval.scaled(rows, [c for c in rows.columns if c not in key], key), key, samples=2)


# -- vectors -----------------------------------------------------------------------------------------------------------


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: each vector whose id is divisible by 50, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(retrieval.nearest(rows.filter("vec_id % 50 = 0"), rows, "vec_id", 5), 5)


def episode_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _in_episode(spark, sf_dir)
    rows = tracking.embeddings(tracking.states(tracking.snapshots(frames)), tracking.dominant_phases(frames))
    key = [*tracking.MATCH, "episode_id"]
    return retrieval.cluster(retrieval.scaled(rows, [c for c in rows.columns if c not in key], key), k=8, starts=10).drop("v")


# -- SQL ---------------------------------------------------------------------------------------------------------------

_SPADL = fixtures.SPADL_SQL.format(events="events")
_TRACK = fixtures.TRACKING_SQL.format(events="events", nation="nation")
_CELL = "least(greatest(CAST(trunc({v} / {size} * {n}) AS INT), 0), {n} - 1)"
_R, _C = _CELL.format(v="start_y", size="68.0", n=12), _CELL.format(v="start_x", size="105.0", n=16)
_R2, _C2 = _CELL.format(v="end_y", size="68.0", n=12), _CELL.format(v="end_x", size="105.0", n=16)
_MOVE = "(action_type IN ('pass', 'dribble') AND result = 'success')"
_GOAL = "(action_type = 'shot' AND result = 'success')"

#: name: (body, the names it builds on). fmt: off
_CTE = {
    "spadl": (_SPADL, ()),
    "counted": (f"SELECT {_R} AS r, {_C} AS c, count(*) FILTER (action_type = 'shot') AS shots, count(*) FILTER {_GOAL} AS goals, count(*) FILTER {_MOVE} AS moves FROM spadl GROUP BY 1, 2", ("spadl",)),
    "steps": (f"SELECT {_R} AS r, {_C} AS c, {_R2} AS r2, {_C2} AS c2, count(*) AS n FROM spadl WHERE {_MOVE} GROUP BY 1, 2, 3, 4", ("spadl",)),
    "cells": ("""SELECT CAST(i // 16 AS INT) AS r, CAST(i % 16 AS INT) AS c, CASE WHEN shots + moves > 0 THEN shots / (shots + moves) ELSE 0.0 END AS shoot_prob, CASE WHEN shots > 0 THEN goals / shots ELSE 0.0 END AS goal_prob,
        CASE WHEN shots + moves > 0 THEN moves / (shots + moves) ELSE 0.0 END AS move_prob, coalesce(moves, 0) AS moves FROM range(192) t(i) LEFT JOIN counted ON counted.r = i // 16 AND counted.c = i % 16""", ("counted",)),
    "xt0": ("SELECT r, c, 0.0::DOUBLE AS xt FROM cells", ("cells",)),
    "valued": (f"""SELECT s.*, g.xt, CASE WHEN {_MOVE} THEN h.xt - g.xt END AS xt_delta FROM spadl s JOIN xt{SWEEPS} g ON g.r = {_R} AND g.c = {_C} JOIN xt{SWEEPS} h ON h.r = {_R2} AND h.c = {_C2}""", ("spadl", f"xt{SWEEPS}")),
    "zone": ("""SELECT match_id, team_id, count(*) FILTER (action_type = 'pass' AND start_x < 42.0) AS zp, count(*) FILTER (action_type IN ('tackle', 'interception', 'foul', 'block', 'clearance') AND start_x < 42.0) AS pr,
        count(*) FILTER (action_type = 'pass' AND start_x >= 70.0) AS tp, count(*) AS n, count(*) FILTER (action_type = 'shot') AS shots, count(*) FILTER (action_type = 'shot' AND result = 'success') AS goals FROM spadl GROUP BY 1, 2""", ("spadl",)),
    "press": ("""SELECT a.match_id, a.team_id, b.team_id AS opponent_id, CASE WHEN a.pr > 0 THEN b.zp / a.pr END AS ppda, CASE WHEN a.tp + b.tp > 0 THEN a.tp / (a.tp + b.tp) ELSE 0.0 END AS field_tilt
        FROM zone a JOIN zone b ON a.match_id = b.match_id AND a.team_id <> b.team_id""", ("zone",)),
    "gained": ("SELECT match_id, team_id, sum(greatest(coalesce(xt_delta, 0.0), 0.0)) AS gain FROM valued GROUP BY 1, 2", ("valued",)),
    "profile": ("""SELECT p.match_id, p.team_id, g.gain AS xt_generated, h.gain AS xt_conceded, coalesce(p.ppda, 50.0) AS ppda, p.field_tilt, CAST(z.shots AS DOUBLE) AS shots, CAST(z.goals AS DOUBLE) AS goals, z.n
        FROM press p JOIN gained g ON g.match_id = p.match_id AND g.team_id = p.team_id JOIN gained h ON h.match_id = p.match_id AND h.team_id = p.opponent_id JOIN zone z ON z.match_id = p.match_id AND z.team_id = p.team_id""", ("press", "gained")),
    "long": ("SELECT match_id, team_id, metric, value FROM (SELECT match_id, team_id, xt_generated, xt_conceded, ppda, field_tilt, shots, goals FROM profile) UNPIVOT (value FOR metric IN (xt_generated, xt_conceded, ppda, field_tilt, shots, goals))", ("profile",)),
    "base": ("SELECT metric, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM long GROUP BY 1", ("long",)),
    "nodes": ("""SELECT match_id, team_id, player_id, touches, x, y FROM (SELECT *, count(*) FILTER (touches >= 10) OVER (PARTITION BY match_id, team_id) AS busy, row_number() OVER (PARTITION BY match_id, team_id ORDER BY touches DESC, player_id) AS place
        FROM (SELECT match_id, team_id, player_id, count(*) AS touches, avg(start_x) AS x, avg(start_y) AS y FROM spadl GROUP BY 1, 2, 3)) WHERE CASE WHEN busy >= 11 THEN touches >= 10 ELSE place <= 14 END""", ("spadl",)),
    "track": (_TRACK, ()),
    "moved": ("""SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (SELECT *, coalesce((x - lag(x) OVER w) / (time_seconds - lag(time_seconds) OVER w), 0) AS vx, coalesce((y - lag(y) OVER w) / (time_seconds - lag(time_seconds) OVER w), 0) AS vy
        FROM track WINDOW w AS (PARTITION BY match_id, period, coalesce(player_id, 'BALL') ORDER BY frame_id))""", ("track",)),
    "fast": ("""SELECT * REPLACE (CASE WHEN ok THEN vx ELSE 0 END AS vx, CASE WHEN ok THEN vy ELSE 0 END AS vy, CASE WHEN ok THEN speed ELSE 0 END AS speed) FROM (SELECT *, speed <= CASE WHEN is_ball THEN 50.0 ELSE 12.0 END AS ok FROM moved)""", ("moved",)),
    "ball": ("SELECT match_id, period, frame_id, x AS bx, y AS b_y, vx AS bvx, vy AS bvy FROM fast WHERE is_ball AND visible", ("fast",)),
    "spine": ("SELECT f.*, bx, b_y, bvx, bvy FROM (SELECT match_id, period, frame_id, min(time_seconds) AS t FROM track GROUP BY 1, 2, 3) f LEFT JOIN ball USING (match_id, period, frame_id)", ("track", "ball")),
    "gaps": ("SELECT p.match_id, p.period, p.frame_id, p.team_id, min(sqrt((p.x - b.bx) * (p.x - b.bx) + (p.y - b.b_y) * (p.y - b.b_y))) AS d FROM track p JOIN ball b USING (match_id, period, frame_id) WHERE NOT p.is_ball AND p.visible GROUP BY 1, 2, 3, 4", ("track", "ball")),
    "ranked": ("SELECT *, row_number() OVER w AS place, lead(d) OVER w AS second FROM gaps WINDOW w AS (PARTITION BY match_id, period, frame_id ORDER BY d, team_id)", ("gaps",)),
    "raw": ("SELECT s.*, r.team_id AS raw_team FROM spine s LEFT JOIN (SELECT * FROM ranked WHERE place = 1 AND d <= 2.5 AND (second IS NULL OR second - d >= 1.0)) r USING (match_id, period, frame_id)", ("spine", "ranked")),
    "run1": ("SELECT *, sum(new) OVER (PARTITION BY match_id, period ORDER BY frame_id) AS run FROM (SELECT *, CASE WHEN raw_team IS DISTINCT FROM lag(raw_team) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM raw WINDOW w AS (PARTITION BY match_id, period ORDER BY frame_id))", ("raw",)),
    "smooth": ("""SELECT *, last_value(held IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS possession_team
        FROM (SELECT *, CASE WHEN raw_team IS NOT NULL AND row_number() OVER (PARTITION BY match_id, period, run ORDER BY frame_id) >= 5 THEN raw_team END AS held FROM run1)""", ("run1",)),
    "phased": ("""SELECT *, CASE WHEN possession_team IS NULL THEN 'set_piece' WHEN t - last_value(flip IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY frame_id ROWS UNBOUNDED PRECEDING) <= 6 THEN 'att_transition'
        WHEN (possession_team = 'home' AND bx < 35) OR (possession_team = 'away' AND bx > 70) THEN 'build_up' WHEN (possession_team = 'home' AND bx > 70) OR (possession_team = 'away' AND bx < 35) THEN 'finishing' ELSE 'progression' END AS phase
        FROM (SELECT *, CASE WHEN possession_team IS NOT NULL AND possession_team IS DISTINCT FROM lag(possession_team) OVER (PARTITION BY match_id, period ORDER BY frame_id) THEN t END AS flip FROM smooth)""", ("smooth",)),
    "stretch": ("""SELECT *, sum(CASE WHEN dead THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, period ORDER BY frame_id) AS live FROM (SELECT *, bx IS NULL AND count(*) OVER (PARTITION BY match_id, period, seen) >= 5 AS dead
        FROM (SELECT *, frame_id - row_number() OVER (PARTITION BY match_id, period, bx IS NULL ORDER BY frame_id) + CASE WHEN bx IS NULL THEN 10000000 ELSE 0 END AS seen FROM phased))""", ("phased",)),
    "owned": ("SELECT *, CASE WHEN NOT dead THEN last_value(possession_team IGNORE NULLS) OVER (PARTITION BY match_id, period, live ORDER BY frame_id ROWS UNBOUNDED PRECEDING) END AS team FROM stretch", ("stretch",)),
    "tagged": ("""SELECT *, sum(new2) OVER (PARTITION BY match_id, period ORDER BY frame_id) AS part FROM (SELECT *, lead(dead) OVER w AS next_dead, CASE WHEN team IS DISTINCT FROM lag(team) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new2
        FROM owned WINDOW w AS (PARTITION BY match_id, period ORDER BY frame_id))""", ("owned",)),
    "eps": ("""SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY start_frame) - 1 AS episode_id FROM (SELECT match_id, period, part, team, min(frame_id) AS start_frame, max(frame_id) AS end_frame, min(t) AS start_time_s, max(t) AS end_time_s,
        list(next_dead ORDER BY frame_id DESC)[1] AS nd FROM tagged WHERE team IS NOT NULL GROUP BY 1, 2, 3, 4)""", ("tagged",)),
    "inside": ("SELECT g.*, e.episode_id, e.start_time_s, e.end_time_s, CASE WHEN g.team = 'home' THEN g.bx ELSE 105.0 - g.bx END AS ox FROM tagged g JOIN eps e USING (match_id, period, part)", ("tagged", "eps")),
    "lasts": ("SELECT match_id, period, episode_id, ox, bx, b_y, sqrt(bvx * bvx + bvy * bvy) AS v FROM inside WHERE bx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, period, episode_id ORDER BY frame_id DESC) = 1", ("inside",)),
    "people": ("SELECT match_id, period, frame_id, team_id, player_id, CASE WHEN team_id = 'home' THEN x ELSE 105.0 - x END AS x, CASE WHEN team_id = 'home' THEN y ELSE 68.0 - y END AS y FROM track WHERE NOT is_ball AND visible", ("track",)),
    "keepers": ("SELECT match_id, period, team_id, player_id FROM (SELECT match_id, period, team_id, player_id, avg(x) AS m FROM people GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY match_id, period, team_id ORDER BY m, player_id) = 1", ("people",)),
    "field": ("SELECT p.*, row_number() OVER (PARTITION BY match_id, period, frame_id, team_id ORDER BY x) AS low, row_number() OVER (PARTITION BY match_id, period, frame_id, team_id ORDER BY x DESC) AS high FROM people p ANTI JOIN keepers k USING (match_id, period, team_id, player_id)", ("people", "keepers")),
}
for _k in range(1, SWEEPS + 1):
    _CTE[f"xt{_k}"] = (f"SELECT a.r, a.c, a.shoot_prob * a.goal_prob + a.move_prob * coalesce((SELECT sum(s.n / a.moves * v.xt) FROM steps s JOIN xt{_k - 1} v ON v.r = s.r2 AND v.c = s.c2 WHERE s.r = a.r AND s.c = a.c), 0.0) AS xt FROM cells a", ("cells", "steps", f"xt{_k - 1}"))

_KEYS = "match_id, period, episode_id"
_SQL = {
    "actions": ("SELECT * FROM spadl", ("spadl",)),
    "xt_counts": ("SELECT * FROM counted", ("counted",)),
    "xt_transitions": ("SELECT * FROM steps", ("steps",)),
    "xt_grid": (f"SELECT r, c, round(xt, 6) AS xt, round(shoot_prob, 6) AS shoot_prob, round(goal_prob, 6) AS goal_prob, round(move_prob, 6) AS move_prob FROM xt{SWEEPS} JOIN cells USING (r, c)", ("cells", f"xt{SWEEPS}")),
    "xt_values": ("SELECT match_id, seq, round(xt, 6) AS xt, round(xt_delta, 6) + 0.0 AS xt_delta FROM valued", ("valued",)),
    "vaep_labels": (f"""SELECT match_id, seq, coalesce(bool_or(g AND gt = team_id), false) AS scores, coalesce(bool_or(g AND gt <> team_id), false) AS concedes FROM (SELECT a.match_id, a.seq, a.team_id, b.team_id AS gt, b.g
        FROM numbered a JOIN numbered b ON a.match_id = b.match_id AND b.k BETWEEN a.k AND a.k + 10) GROUP BY 1, 2""", ("numbered",)),
    "running_score": (f"""SELECT match_id, seq, team_id, coalesce(sum(CASE WHEN {_GOAL} AND team_id = 'home' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS goals_home, coalesce(sum(CASE WHEN {_GOAL} AND team_id = 'away' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS goals_away
        FROM spadl WINDOW w AS (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("spadl",)),
    "pressing": ("SELECT * REPLACE (round(ppda, 6) AS ppda, round(field_tilt, 6) AS field_tilt) FROM press", ("press",)),
    "team_profiles": ("SELECT * REPLACE (round(xt_generated, 6) AS xt_generated, round(xt_conceded, 6) AS xt_conceded, round(ppda, 6) AS ppda, round(field_tilt, 6) AS field_tilt) FROM profile", ("profile",)),
    "profile_scores": ("""SELECT match_id, team_id, metric, round(value, 5) AS value, round(z, 5) + 0.0 AS z, round(adj, 5) + 0.0 AS adjusted_z, CASE WHEN adj >= 0.5 THEN 'strength' WHEN adj <= -0.5 THEN 'weakness' ELSE 'neutral' END AS verdict
        FROM (SELECT *, CASE WHEN metric IN ('ppda', 'xt_conceded') THEN -z ELSE z END AS adj FROM (SELECT l.*, CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0 END AS z FROM long l JOIN base USING (metric)))""", ("long", "base")),
    "team_summary": ("SELECT match_id, team_id, count(*) FILTER (action_type = 'pass') AS passes, count(*) FILTER (action_type = 'shot') AS shots, count(*) FILTER (action_type = 'shot' AND result = 'success') AS goals, round(sum(xt_delta), 6) + 0.0 AS xt FROM valued GROUP BY 1, 2", ("valued",)),
    "top_players": ("""SELECT match_id, player_id, xt, n, CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY xt DESC, player_id) AS place
        FROM (SELECT match_id, player_id, round(sum(xt_delta), 3) AS xt, count(*) AS n FROM valued WHERE xt_delta > 0 GROUP BY 1, 2)) WHERE place <= 10""", ("valued",)),
    "match_scores": (f"SELECT match_id, count(*) FILTER ({_GOAL} AND team_id = 'home') AS home_goals, count(*) FILTER ({_GOAL} AND team_id = 'away') AS away_goals FROM spadl GROUP BY 1", ("spadl",)),
    "action_map": (f"SELECT match_id, team_id, count(*) FILTER (action_type IN ('pass', 'dribble')) AS moves, count(*) FILTER (action_type = 'shot') AS shots, count(*) FILTER {_GOAL} AS goals, count(*) FILTER (action_type IN ('interception', 'clearance', 'tackle', 'foul')) AS defensive FROM spadl GROUP BY 1, 2", ("spadl",)),
    "network_nodes": ("SELECT match_id, team_id, player_id, touches, round(x, 6) AS x, round(y, 6) AS y FROM nodes", ("nodes",)),
    "network_edges": ("""SELECT * FROM (SELECT match_id, team_id, player_id, receiver_id, count(*) AS passes FROM (SELECT *, lead(player_id) OVER (PARTITION BY match_id, team_id ORDER BY period, time_seconds, seq) AS receiver_id FROM spadl)
        WHERE action_type = 'pass' AND result = 'success' AND player_id <> receiver_id GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3) e SEMI JOIN nodes n USING (match_id, team_id, player_id)
        WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.match_id = e.match_id AND m.team_id = e.team_id AND m.player_id = e.receiver_id)""", ("spadl", "nodes")),
    "velocities": ("SELECT match_id, period, frame_id, coalesce(player_id, 'BALL') AS who, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(speed, 6) AS speed FROM fast", ("fast",)),
    "possession": ("SELECT match_id, period, frame_id, raw_team, possession_team FROM smooth", ("smooth",)),
    "phases": ("SELECT match_id, period, frame_id, possession_team, phase FROM phased", ("phased",)),
    "phase_segments": ("""SELECT match_id, period, phase, min(frame_id) AS start_frame, max(frame_id) AS end_frame, min(t) AS start_time_s, max(t) AS end_time_s, count(*) AS n_frames, round(max(t) - min(t), 3) AS duration_s
        FROM (SELECT *, frame_id - row_number() OVER (PARTITION BY match_id, period, phase ORDER BY frame_id) AS seg FROM phased) GROUP BY match_id, period, phase, seg""", ("phased",)),
    "episodes": ("""SELECT match_id, period, CAST(episode_id AS INT) AS episode_id, start_frame, end_frame, start_time_s, end_time_s, round(end_time_s - start_time_s, 3) AS duration_s, team AS possession_team,
        CASE WHEN nd IS NULL THEN 'match_end' WHEN nd THEN 'out_of_play' ELSE 'possession_change' END AS end_reason FROM eps""", ("eps",)),
    "episode_outcomes": (f"""SELECT e.match_id, e.period, CAST(e.episode_id AS INT) AS episode_id, CASE WHEN nd IS NULL THEN 'match_end' WHEN nd THEN 'out_of_play' ELSE 'possession_change' END AS end_reason, round(end_time_s - start_time_s, 3) AS duration_s,
        coalesce(i.third, false) AS reached_final_third, coalesce(l.ox >= 88.5 AND l.b_y BETWEEN 13.84 AND 54.16, false) AS ended_in_box, coalesce(l.ox >= 88.5 AND l.b_y BETWEEN 13.84 AND 54.16 AND l.v >= 12.0, false) AS shot_like,
        l.bx AS end_ball_x, l.b_y AS end_ball_y, round(l.v, 6) AS end_ball_speed FROM eps e JOIN (SELECT {_KEYS}, bool_or(ox > 70.0) AS third FROM inside GROUP BY ALL) i USING ({_KEYS}) LEFT JOIN lasts l USING ({_KEYS})""", ("eps", "inside", "lasts")),
    "dominant_phases": (f"SELECT match_id, period, CAST(episode_id AS INT) AS episode_id, phase FROM (SELECT {_KEYS}, phase, count(*) AS n FROM inside GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY n DESC, phase) = 1", ("inside",)),
    "nearest_vectors": ("""SELECT query, vec_id, round(d, 5) AS distance, CAST(place - 1 AS INT) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS place FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 5""", ()),
}
_SQL["vaep_features"] = (
    "SELECT match_id, seq, start_x AS start_x_oriented, start_y, end_x AS end_x_oriented, end_y, round(sqrt((105 - start_x) ** 2 + (34 - start_y) ** 2), 6) AS distance_to_goal_start, round(sqrt((105 - end_x) ** 2 + (34 - end_y) ** 2), 6) AS distance_to_goal_end, "
    "round(atan2(7.32 * greatest(105 - start_x, 1e-6), (105 - start_x) ** 2 + (34 - start_y) ** 2 - 3.66 ** 2), 6) AS angle_to_goal_start, CAST(period AS DOUBLE) AS period, greatest(time_seconds, 0.0) AS time_since_period_start, "
    + ", ".join([f"CAST(coalesce(action_type, '') = '{a}' AS INT)::DOUBLE AS action_{a}" for a in values.ACTIONS] + [f"CAST(coalesce(bodypart, '') = '{b}' AS INT)::DOUBLE AS body_{b}" for b in values.BODIES]) + " FROM spadl",
    ("spadl",),
)
_SQL["short_names"] = ("""SELECT n_nationkey, left(CASE WHEN r_name NOT LIKE '% %' AND rtrim(lower(part), '.') IN ('van', 'de', 'mc', 'ter') THEN part || ' ' || last ELSE last END, 14) AS short
    FROM (SELECT n_nationkey, r_name, ['van', 'De', 'mc.', 'of', 'TER', ''][n_nationkey % 6 + 1] AS part, list_last(string_split(r_name, ' ')) AS last FROM nation JOIN region ON n_regionkey = r_regionkey)""", ())
_SQL["geometry_points"] = ("""SELECT seq, round(u / 120 * 105, 6) + 0.0 AS bottom_left_x, round(v / 80 * 68, 6) AS bottom_left_y, round(u / 120 * 105, 6) + 0.0 AS top_left_x, round((1 - v / 80) * 68, 6) + 0.0 AS top_left_y, round((u - 60) / 120 * 105 + 52.5, 6) + 0.0 AS center_x, round((v - 40) / 80 * 68 + 34, 6) AS center_y,
    round(nx, 6) + 0.0 AS norm_x, round(ny, 6) + 0.0 AS norm_y, nx BETWEEN 0 AND 105 AND ny BETWEEN 0 AND 68 AS inside, printf('P%d  %02d:%05.2f', period, CAST(floor(time_seconds / 60) AS INT), time_seconds - floor(time_seconds / 60) * 60) AS clock
    FROM (SELECT *, CASE WHEN period = 1 THEN u ELSE 105 - u END AS nx, CASE WHEN period = 1 THEN v ELSE 68 - v END AS ny FROM (SELECT *, start_x - 3 AS u, start_y + 2 AS v FROM spadl))""", ("spadl",))
_SQL["action_violations"] = ("""SELECT 'start_x' AS column_name, 'range' AS rule, count(*) AS n FROM spadl WHERE seq % 11 = 0 HAVING count(*) > 0 UNION ALL SELECT 'team_id', 'null', count(*) FROM spadl WHERE seq % 13 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'period', 'range', count(*) FROM spadl WHERE seq % 17 = 0 HAVING count(*) > 0""", ("spadl",))
_SQL["episode_values"] = (f"""SELECT e.match_id, e.period, CAST(e.episode_id AS INT) AS episode_id, round(CASE WHEN coalesce(l.ox >= 88.5 AND l.b_y BETWEEN 13.84 AND 54.16 AND l.v >= 12.0, false) THEN 1.0 WHEN coalesce(l.ox >= 88.5 AND l.b_y BETWEEN 13.84 AND 54.16, false) THEN 0.6
    WHEN coalesce(i.third, false) THEN 0.3 ELSE 0.05 END + 0.01 * round(end_time_s - start_time_s, 3), 6) AS value FROM eps e JOIN (SELECT {_KEYS}, bool_or(ox > 70.0) AS third FROM inside GROUP BY ALL) i USING ({_KEYS}) LEFT JOIN lasts l USING ({_KEYS})""", ("eps", "inside", "lasts"))
_CTE["numbered"] = (f"SELECT match_id, seq, team_id, coalesce({_GOAL}, false) AS g, row_number() OVER (PARTITION BY match_id ORDER BY seq) AS k FROM spadl", ("spadl",))
_CTE["seen"] = ("SELECT match_id, period, frame_id, team_id, player_id, x, y, vx, vy FROM fast WHERE NOT is_ball AND visible AND x IS NOT NULL AND y IS NOT NULL", ("fast",))
_CTE["snaps"] = (f"""SELECT DISTINCT {_KEYS}, frame_id FROM (SELECT {_KEYS}, frame_id, row_number() OVER (PARTITION BY {_KEYS}, k ORDER BY round(abs(t - target), 9), frame_id) AS place FROM inside JOIN
    (SELECT {_KEYS}, k, start_time_s + k * CASE WHEN n > 1 THEN (end_time_s - start_time_s) / (n - 1) ELSE 0 END AS target FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT {_KEYS}, start_time_s, end_time_s,
    CAST(CASE WHEN round(end_time_s - start_time_s, 3) <= 0 THEN 1 ELSE greatest(2, round_even(round(end_time_s - start_time_s, 3) * 2, 0) + 1) END AS INT) AS n FROM eps))) USING ({_KEYS})) WHERE place = 1""", ("inside", "eps"))
_CTE["shots"] = (f"SELECT i.* FROM inside i JOIN snaps USING ({_KEYS}, frame_id)", ("inside", "snaps"))
_CTE["grid"] = ("SELECT r, c, CAST((c + 0.5) * 1.75 AS DOUBLE) AS cx, CAST((r + 0.5) * 1.7 AS DOUBLE) AS cy FROM (SELECT unnest(range(40)) AS r), (SELECT unnest(range(60)) AS c)", ())
_CTE["goals"] = ("""SELECT *, CASE WHEN cx > 105 THEN 0.0 ELSE 1 / (1 + exp(-(1.2 - 0.12 * sqrt((105 - cx) * (105 - cx) + (34 - cy) * (34 - cy)) + 1.5 * acos(least(greatest(((105 - cx) * (105 - cx) + low * high) / (sqrt((105 - cx) * (105 - cx) + low * low) * sqrt((105 - cx) * (105 - cx) + high * high) + 1e-9), -1.0), 1.0))))) END AS goal
    FROM (SELECT *, 34 - 3.66 - cy AS low, 34 + 3.66 - cy AS high FROM grid)""", ("grid",))
_CTE["reach"] = (f"""SELECT s.match_id, s.period, s.episode_id, s.frame_id, bx, b_y, r, c, cx, cy, goal, min(CASE WHEN p.team_id = s.team THEN sqrt((cx - p.x - 0.7 * p.vx) * (cx - p.x - 0.7 * p.vx) + (cy - p.y - 0.7 * p.vy) * (cy - p.y - 0.7 * p.vy)) / 5 END) AS a,
    min(CASE WHEN p.team_id <> s.team THEN sqrt((cx - p.x - 0.7 * p.vx) * (cx - p.x - 0.7 * p.vx) + (cy - p.y - 0.7 * p.vy) * (cy - p.y - 0.7 * p.vy)) / 5 END) AS d FROM shots s JOIN seen p USING (match_id, period, frame_id) CROSS JOIN goals GROUP BY ALL""", ("shots", "seen", "goals"))
_CTE["threats"] = (f"""SELECT *, row_number() OVER (PARTITION BY {_KEYS}, frame_id ORDER BY obso DESC, r, c) AS place FROM (SELECT {_KEYS}, frame_id, r, c, cx, cy,
    goal * coalesce(exp(-((cx - bx) * (cx - bx) + (cy - b_y) * (cy - b_y)) / 800), 1.0) / (1 + exp(-least(greatest((d - a) / 0.45, -30.0), 30.0))) AS obso FROM reach)""", ("reach",))
_CTE["tops"] = ("SELECT * FROM threats WHERE place = 1", ("threats",))
_CTE["nearby"] = (f"""SELECT s.match_id, s.period, s.episode_id, s.frame_id, s.team, p.player_id, sqrt((p.x - bx) * (p.x - bx) + (p.y - b_y) * (p.y - b_y)) AS d, row_number() OVER (PARTITION BY s.match_id, s.period, s.episode_id, s.frame_id ORDER BY sqrt((p.x - bx) * (p.x - bx) + (p.y - b_y) * (p.y - b_y)), p.player_id) AS place
    FROM inside s JOIN seen p ON p.match_id = s.match_id AND p.period = s.period AND p.frame_id = s.frame_id AND p.team_id = s.team WHERE bx IS NOT NULL""", ("inside", "seen"))
_E = "match_id, period, CAST(episode_id AS INT) AS episode_id"
_SQL["snapshots"] = (f"SELECT {_E}, frame_id FROM snaps", ("snaps",))
_SQL["phase_totals"] = ("""SELECT match_id, phase, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_frames, round(sum(s), 6) AS total_s FROM (SELECT match_id, period, phase, part, count(*) AS n, round(max(t) - min(t), 3) AS s FROM (SELECT *, sum(new3) OVER (PARTITION BY match_id, period ORDER BY frame_id) AS part
    FROM (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY match_id, period ORDER BY frame_id) THEN 1 ELSE 0 END AS new3 FROM phased)) GROUP BY ALL) GROUP BY ALL""", ("phased",))
_SQL["episode_triggers"] = (f"SELECT {_E}, min(frame_id) FILTER (ox > 70) AS trigger_frame, round(min(t) FILTER (ox > 70), 6) AS trigger_time_s FROM shots GROUP BY ALL", ("shots",))
_SQL["mean_positions"] = (f"SELECT {_E}, team, player_id, round(avg(p.x), 6) + 0.0 AS x, round(avg(p.y), 6) + 0.0 AS y FROM inside i JOIN seen p USING (match_id, period, frame_id) WHERE p.team_id = i.team GROUP BY ALL", ("inside", "seen"))
_SQL["ball_holders"] = ("""SELECT match_id, period, frame_id, player_id, round(d, 6) AS distance_m, round(second - d, 6) AS margin_m FROM (SELECT match_id, period, frame_id, player_id, d, lead(d) OVER w AS second, row_number() OVER w AS place
    FROM (SELECT p.*, sqrt((p.x - bx) * (p.x - bx) + (p.y - b_y) * (p.y - b_y)) AS d FROM seen p JOIN ball USING (match_id, period, frame_id) WHERE bx IS NOT NULL AND b_y IS NOT NULL) WINDOW w AS (PARTITION BY match_id, period, frame_id ORDER BY d, player_id)) WHERE place = 1""", ("seen", "ball"))
_SQL["shot_strikes"] = (f"""SELECT {_E}, frame_id AS strike_frame, round(t, 6) AS strike_time_s, round(t - start_time_s, 6) AS strike_rel_time_s, round(v, 6) AS ball_speed_at_strike, bx AS ball_x, b_y AS ball_y, player_id AS shot_taker, round(d, 6) AS shot_taker_distance_m, v >= 12 AS above_threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY v < 12, CASE WHEN v < 12 THEN -v ELSE 0 END, frame_id) AS first FROM (SELECT *, sqrt(bvx * bvx + bvy * bvy) AS v FROM inside WHERE bx IS NOT NULL)) s JOIN nearby n USING ({_KEYS}, frame_id) WHERE first = 1 AND n.place = 1""", ("inside", "nearby"))
_SQL["obso_trajectory"] = (f"SELECT {_E}, frame_id, round(obso, 6) AS obso_max, round(cx, 6) AS obso_argmax_x, round(cy, 6) AS obso_argmax_y FROM tops", ("tops",))
_SQL["decisive_frames"] = (f"""SELECT {_E}, round(peak, 6) AS peak_obso, frame_id AS decisive_frame, round(obso, 6) AS decisive_obso FROM (SELECT *, max(obso) OVER (PARTITION BY {_KEYS}) AS peak FROM tops) WHERE obso >= 0.5 * peak QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY frame_id) = 1""", ("tops",))
_SQL["td_credit"] = (f"""SELECT {_E}, team_id, player_id, round(credit, 6) + 0.0 AS credit, n_snapshots_carrier, n_snapshots_near_ball, CAST(row_number() OVER (PARTITION BY {_KEYS} ORDER BY credit DESC, player_id) AS INT) AS rank FROM (SELECT {_KEYS}, team AS team_id, player_id, sum(CASE WHEN n.place = 1 THEN 1.0 ELSE 0.3 END * gain) AS credit,
    count(*) FILTER (n.place = 1) AS n_snapshots_carrier, count(*) FILTER (n.place > 1) AS n_snapshots_near_ball FROM nearby n JOIN (SELECT {_KEYS}, frame_id, lead(obso) OVER (PARTITION BY {_KEYS} ORDER BY frame_id) - obso AS gain FROM tops) USING ({_KEYS}, frame_id) WHERE gain IS NOT NULL AND (n.place = 1 OR n.d <= 10) GROUP BY ALL)""", ("nearby", "tops"))

_CTE["state"] = (f"""SELECT s.match_id, s.period, s.episode_id, s.frame_id, s.t AS time_s, round(s.t - s.start_time_s, 3) AS rel_time_s, s.team AS possession_team, s.bx AS ball_x, s.b_y AS ball_y, s.ox AS ball_x_oriented, sqrt(s.bvx * s.bvx + s.bvy * s.bvy) AS ball_speed,
    CAST(count(p.x) FILTER (own) AS INT) AS attackers_visible, CAST(count(p.x) FILTER (NOT own) AS INT) AS defenders_visible, avg(px) FILTER (own) AS attackers_mean_x_oriented, CASE WHEN count(p.x) FILTER (own) >= 2 THEN max(p.x) FILTER (own) - min(p.x) FILTER (own) END AS attackers_length,
    CASE WHEN count(p.x) FILTER (own) >= 2 THEN max(p.y) FILTER (own) - min(p.y) FILTER (own) END AS attackers_width, avg(px) FILTER (NOT own) AS defenders_mean_x_oriented, min(px) FILTER (NOT own) AS defenders_line_height_oriented, stddev_samp(p.x) FILTER (NOT own) AS defenders_compactness_x
    FROM shots s LEFT JOIN (SELECT s.match_id, s.period, s.frame_id, p.x, p.y, p.team_id = s.team AS own, CASE WHEN s.team = 'home' THEN p.x ELSE 105 - p.x END AS px FROM shots s JOIN seen p USING (match_id, period, frame_id)) p USING (match_id, period, frame_id) GROUP BY ALL""", ("shots", "seen"))
_STATE = ("time_s", "rel_time_s", "ball_x", "ball_y", "ball_x_oriented", "ball_speed", "attackers_mean_x_oriented", "attackers_length", "attackers_width", "defenders_mean_x_oriented", "defenders_line_height_oriented", "defenders_compactness_x")
_SQL["states"] = (f"SELECT {_E}, frame_id, possession_team, attackers_visible, defenders_visible, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _STATE) + " FROM state", ("state",))
_FIRST = "arg_{0}({1}, frame_id) FILTER ({1} IS NOT NULL)"
_MEANS = ("attackers_mean_x_oriented", "defenders_line_height_oriented", "attackers_length", "attackers_width", "attackers_visible", "defenders_visible")
_NUMBERS = {
    "duration_s": "max(rel_time_s) - min(rel_time_s)", "start_ball_x_oriented": _FIRST.format("min", "ball_x_oriented"), "start_ball_y": _FIRST.format("min", "ball_y"), "end_ball_x_oriented": _FIRST.format("max", "ball_x_oriented"), "end_ball_y": _FIRST.format("max", "ball_y"),
    "max_ball_x_oriented": "max(ball_x_oriented)", "ball_x_displacement": f"max(ball_x_oriented) - {_FIRST.format('min', 'ball_x_oriented')}", "mean_ball_speed": "avg(ball_speed)", "max_ball_speed": "max(ball_speed)",
    "ball_x_slope": "CASE WHEN max(rel_time_s) - min(rel_time_s) >= 1e-6 THEN regr_slope(ball_x_oriented, rel_time_s) END", **{f"mean_{c}": f"avg({c})" for c in _MEANS}, "compactness_diff": "coalesce(avg(defenders_compactness_x), 0) - coalesce(avg(attackers_length), 0)",
}
_CTE["moods"] = (f"SELECT {_KEYS}, phase FROM (SELECT {_KEYS}, phase, count(*) AS n FROM inside GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY n DESC, phase) = 1", ("inside",))
_SQL["episode_embeddings"] = (f"SELECT {_E}, " + ", ".join(f"coalesce(round({c}, 6) + 0.0, 0.0) AS {c}" for c in _NUMBERS) + ", " + ", ".join(f"CAST(phase = '{p}' AS DOUBLE) AS phase_{p}" for p in tracking.PHASES)
    + f" FROM (SELECT {_KEYS}, " + ", ".join(f"{v} AS {c}" for c, v in _NUMBERS.items()) + f" FROM state GROUP BY ALL) JOIN moods USING ({_KEYS})", ("state", "moods"))
_SQL["smoothed_holders"] = ("""SELECT match_id, period, frame_id, coalesce(last_value(held IGNORE NULLS) OVER w, first_value(clear IGNORE NULLS) OVER w) AS holder FROM (SELECT *, CASE WHEN clear IS NOT NULL AND row_number() OVER (PARTITION BY match_id, period, run ORDER BY frame_id) >= 4 THEN clear END AS held
    FROM (SELECT *, sum(new4) OVER (PARTITION BY match_id, period ORDER BY frame_id) AS run FROM (SELECT *, CASE WHEN clear IS DISTINCT FROM lag(clear) OVER (PARTITION BY match_id, period ORDER BY frame_id) THEN 1 ELSE 0 END AS new4 FROM (SELECT s.match_id, s.period, s.frame_id, CASE WHEN second IS NULL OR second - d >= 0.5 THEN player_id END AS clear
    FROM spine s LEFT JOIN (SELECT match_id, period, frame_id, player_id, d, lead(d) OVER o AS second, row_number() OVER o AS place FROM (SELECT p.*, sqrt((p.x - bx) * (p.x - bx) + (p.y - b_y) * (p.y - b_y)) AS d FROM seen p JOIN ball USING (match_id, period, frame_id) WHERE bx IS NOT NULL AND b_y IS NOT NULL)
    WINDOW o AS (PARTITION BY match_id, period, frame_id ORDER BY d, player_id)) h ON h.match_id = s.match_id AND h.period = s.period AND h.frame_id = s.frame_id AND place = 1)))) WINDOW w AS (PARTITION BY match_id, period ORDER BY frame_id ROWS UNBOUNDED PRECEDING)""", ("spine", "seen", "ball"))
_NEAR = "min(CASE WHEN p.team_id {0} m.team THEN sqrt((cx - p.x - 0.7 * p.vx) * (cx - p.x - 0.7 * p.vx) + (cy - p.y - 0.7 * p.vy) * (cy - p.y - 0.7 * p.vy)) / 5 END)"
_SQL["player_obso"] = (f"""SELECT match_id, period, frame_id, player_id, round(obso, 6) AS obso, CAST(row_number() OVER (PARTITION BY match_id, period, frame_id ORDER BY obso DESC, player_id) AS INT) AS rank FROM (SELECT match_id, period, frame_id, player_id,
    goal * coalesce(exp(-((cx - bx) * (cx - bx) + (cy - b_y) * (cy - b_y)) / 800), 1.0) / (1 + exp(-CASE WHEN d IS NULL THEN 30.0 ELSE least(greatest((d - a) / 0.45, -30.0), 30.0) END)) AS obso FROM (SELECT m.match_id, m.period, m.frame_id, m.player_id, bx, b_y, cx, cy, goal, {_NEAR.format("=")} AS a, {_NEAR.format("<>")} AS d
    FROM (SELECT s.match_id, s.period, s.frame_id, s.team, s.bx, s.b_y, o.player_id, CAST(least(greatest(ceil((o.x - 0.875) / 1.75) - 1, 0), 59) AS INT) AS c, CAST(least(greatest(ceil((o.y - 0.85) / 1.7) - 1, 0), 39) AS INT) AS r FROM shots s JOIN seen o ON o.match_id = s.match_id AND o.period = s.period AND o.frame_id = s.frame_id AND o.team_id = s.team) m
    JOIN goals USING (r, c) JOIN seen p ON p.match_id = m.match_id AND p.period = m.period AND p.frame_id = m.frame_id GROUP BY ALL))""", ("shots", "seen", "goals"))
_SQL["episode_summaries"] = (f"""SELECT match_id, period, episode_id, start_frame, end_frame, start_time_s, end_time_s, e.duration_s, possession_team, phase AS dominant_phase, e.end_reason, reached_final_third, ended_in_box, shot_like, end_ball_x, end_ball_y, end_ball_speed, peak_obso, decisive_obso, coalesce(n, 0) AS n_snapshots
    FROM ({_SQL["episodes"][0]}) e JOIN ({_SQL["episode_outcomes"][0]}) o USING ({_KEYS}) LEFT JOIN ({_SQL["dominant_phases"][0]}) p USING ({_KEYS}) LEFT JOIN ({_SQL["decisive_frames"][0]}) d USING ({_KEYS}) LEFT JOIN (SELECT {_E}, count(*) AS n FROM snaps GROUP BY ALL) s USING ({_KEYS})""",
    tuple(dict.fromkeys((*_SQL["episodes"][1], *_SQL["episode_outcomes"][1], *_SQL["dominant_phases"][1], *_SQL["decisive_frames"][1], "snaps"))))
_ADJ = "(SELECT *, CASE WHEN metric IN ('ppda', 'xt_conceded') THEN -z ELSE z END AS adj FROM (SELECT l.*, CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0 END AS z FROM long l JOIN base USING (metric)))"
_SQL["verdict_lists"] = ("SELECT match_id, team_id, " + ", ".join(f"coalesce(string_agg(metric, ',' ORDER BY metric) FILTER ({c}), '') AS {n}" for n, c in (("strengths", "adj >= 0.5"), ("weaknesses", "adj <= -0.5"), ("neutral", "adj > -0.5 AND adj < 0.5"))) + f" FROM {_ADJ} GROUP BY 1, 2", ("long", "base"))
_SQL["radar"] = ("SELECT match_id, team_id, " + ", ".join(f"round(max(greatest(least(adj, 1.5), -1.5)) FILTER (metric = '{m}'), 5) + 0.0 AS {m}" for m in sorted(team.METRICS)) + f" FROM {_ADJ} GROUP BY 1, 2", ("long", "base"))
_SQL["match_overview"] = (f"SELECT s.*, round(ppda, 6) AS ppda, round(field_tilt, 6) AS field_tilt FROM ({_SQL['team_summary'][0]}) s LEFT JOIN press USING (match_id, team_id)", ("valued", "press"))
_SQL["network_labels"] = ("SELECT match_id, team_id, player_id, CAST(row_number() OVER (PARTITION BY match_id, team_id ORDER BY y, player_id) AS INT) AS y_rank FROM nodes", ("nodes",))

def _density_sql(points: str, key: str, rows: int, cols: int, share: float) -> str:
    """Kernel densities of a query's key, x, y, by the same definition as surfaces.density."""
    return f"""SELECT {key}, CAST(r AS INT) AS r, CAST(c AS INT) AS c, n, round(d, 9) AS density FROM (SELECT *, max(d) OVER (PARTITION BY {key}) AS top FROM (SELECT {key}, r, c, n,
        sum(exp(-0.5 * (vy * (gx - x) ** 2 - 2 * vxy * (gx - x) * (gy - y) + vx * (gy - y) ** 2) / (det * n ** (-1.0 / 3)))) / (2 * pi() * n * n ** (-1.0 / 3) * sqrt(det)) AS d
        FROM ({points}) JOIN (SELECT *, vx * vy - vxy * vxy AS det FROM (SELECT {key}, count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM ({points}) GROUP BY {key})) USING ({key}),
        (SELECT r, c, c * 105.0::DOUBLE / {cols - 1} AS gx, r * 68.0::DOUBLE / {rows - 1} AS gy FROM (SELECT unnest(range({rows})) AS r), (SELECT unnest(range({cols})) AS c))
        WHERE n >= 5 AND det > 1e-12 * vx * vy GROUP BY {key}, r, c, n, det)) WHERE d >= {share} * top"""


_SQL["player_heatmaps"] = (_density_sql("SELECT player_id, start_x AS x, start_y AS y FROM spadl", "player_id", 69, 106, 0.0), ("spadl",))
_SQL["player_positions"] = ("""SELECT player_id, CAST(sum(n) AS BIGINT) AS n, round(sum(sx) / sum(n), 6) AS x, round(sum(sy) / sum(n), 6) AS y, first(team_id ORDER BY n DESC, team_id) AS team_id
    FROM (SELECT player_id, team_id, count(*) AS n, sum(start_x) AS sx, sum(start_y) AS sy FROM spadl GROUP BY 1, 2) GROUP BY 1""", ("spadl",))
_SQL["attack_end_densities"] = (_density_sql(f"""SELECT end_reason, x, y FROM (SELECT CASE WHEN nd IS NULL THEN 'match_end' WHEN nd THEN 'out_of_play' ELSE 'possession_change' END AS end_reason,
    CASE WHEN e.team = 'home' THEN l.bx ELSE 105 - l.bx END AS x, CASE WHEN e.team = 'home' THEN l.b_y ELSE 68 - l.b_y END AS y FROM eps e JOIN lasts l USING ({_KEYS})) WHERE x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68""",
    "end_reason", 130, 200, 0.05), ("eps", "lasts"))
# fmt: on


def _with(body: str, needs: tuple[str, ...]) -> str:
    """The body with all that it builds on before it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in _CTE[name][1]:
                add(x)
            order.append(name)

    for x in needs:
        add(x)
    return ("WITH " + ", ".join(f"{x} AS MATERIALIZED ({_CTE[x][0]})" for x in order) + " " if order else "") + body


_QUERIES = (
    team_profiles, actions, xt_counts, xt_transitions, xt_grid, xt_values, vaep_labels, vaep_features, vaep_scores, running_score, pressing, profile_scores, team_summary, top_players, match_scores,
    action_map, short_names, geometry_points, action_violations, formation_pairs, role_trajectories, tracking_profiles, episode_values, network_nodes, network_edges, velocities, possession, phases, phase_segments, episodes, episode_outcomes, dominant_phases, snapshots, states, episode_embeddings, team_shape,
    obso_trajectory, decisive_frames, player_obso, nearest_vectors, episode_clusters, episode_summaries, phase_totals, episode_triggers, shot_strikes, ball_holders, smoothed_holders, mean_positions, td_credit, leave_one_out, episode_narratives,
    extended_embeddings, defence_recommendations, density_clusters, corpus_clusters, verdict_lists, radar, match_overview, network_labels, player_heatmaps, player_positions, attack_end_densities,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _with(*parts) for name, parts in _SQL.items()}
