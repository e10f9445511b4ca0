"""Formations and roles against plain search; the fixture reaches the cases that matter."""

import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import roles, team, tracking, values
from touchline.plans import fixtures

DATA = Path("/root/testdata/sf0.001")


def test_assignment_equals_search():
    cost = np.random.default_rng(3).random((20, 4, 6))
    slots, least = roles.assign(cost)
    for k in range(20):
        assert least[k] == pytest.approx(min(sum(cost[k, p, s] for p, s in enumerate(x)) for x in itertools.permutations(range(6), 4)))
        assert cost[k, range(4), slots[k]].sum() == pytest.approx(least[k]) and len(set(slots[k])) == 4
    with pytest.raises(ValueError):
        roles.assign(np.zeros((1, 3, 2)))


PLAYERS = "match_id string, period int, frame_id long, time_seconds double, ball struct<x double, y double>, players array<struct<team_id string, player_id string, x double, y double>>, team string, to_right boolean, episode_id int, start_time_s double, end_time_s double, start_frame long, end_frame long, possession_team string"


def frame(k, own, other, tail=()):
    people = [("home", f"h{i}", float(x), float(y)) for i, (x, y) in enumerate(own)] + [("away", f"a{i}", 105.0 - x, 68.0 - y) for i, (x, y) in enumerate(other)]
    return ("m", 1, k, k / 25, (1.0, 1.0), people, "home", True, 0, 0.0, 0.08, 0, 2, "home")


def test_formations_and_roles(spark):
    slots = lambda t: [(3, 34)] + [(x + 1, y) for _, x, y in roles.TEMPLATES[t]]
    df = spark.createDataFrame([frame(0, slots("4-3-3"), slots("4-4-2")), frame(1, slots("4-2-3-1"), slots("4-4-2")[:10]), frame(2, slots("4-3-3")[:9], slots("4-3-3") + [(50, 1)])], PLAYERS)
    got = {(r.frame_id, r.team_id): (r.formation, r.cost) for r in roles.formations(df).collect()}
    assert got[0, "home"] == ("4-3-3", 10.0) and got[0, "away"] == ("4-4-2", pytest.approx(10.0)) and got[1, "home"][0] == "4-2-3-1"
    assert got[1, "away"] == ("4-4-2", pytest.approx(9.0)) and got[2, "home"] == (None, None) and got[2, "away"] == (None, None)
    pair = roles.formation_pairs(df.limit(1), df).collect()
    assert [(r.representative_frame, r.attacker_formation, r.defender_formation) for r in pair] == [(1, "4-2-3-1", "4-4-2")]
    lost = roles.formation_pairs(df.limit(1).withColumn("end_frame", F.lit(100)), df).first()
    assert lost.representative_frame == 50 and lost.attacker_formation is None
    path = roles.role_trajectory(df.filter("frame_id < 2").withColumn("end_time_s", F.lit(0.04)))
    rows = path.filter("frame_id = 0").collect()
    assert {r.player_id: r.role for r in rows} == {f"h{i + 1}": s[0] for i, s in enumerate(roles.TEMPLATES["4-3-3"])} and all(r.displacement == 1.0 for r in rows)


def test_shape_of_small_teams(spark):
    df = spark.createDataFrame([frame(0, [(1, 1), (20, 10), (40, 30)], [(5, 5)])], PLAYERS)
    got = {r.team_id: r for r in tracking.shape(df).collect()}
    assert (got["home"].def_line, got["home"].off_line, got["home"].length, got["home"].n_players) == (20.0, 40.0, 20.0, 2)
    assert (got["away"].n_players, got["away"].length, got["away"].def_line, got["away"].hull_area) == (0, 0.0, 0.0, 0.0)
    profile = roles.tracking_profile(tracking.shape(df), df.withColumn("phase", F.lit("build_up")), 1).collect()
    assert {r.team_id: r.def_line_mean for r in profile} == {"home": 20.0, "away": 0.0} and roles.tracking_profile(tracking.shape(df), df.withColumn("phase", F.lit("x"))).count() == 0


def test_short_names(spark):
    names = {"Ángel Di María": "Di María", "Virgil van Dijk": "van Dijk", "Kevin de. Bruyne": "de. Bruyne", "Cristiano": "Cristiano", "  ": "  ", "A Verylongfamilynamexyz": "Verylongfamily", "John of Gaunt": "Gaunt", "Al Das Neves": "Das Neves"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", team.short_name(F.col("n")).alias("s")).collect()} == names


def test_action_model_before_and_after(spark):
    """Before is the action as it stands; after has its start where it ends; a label with one class is its constant."""
    rows = [("m", i, 1 + i % 2, float(i), "home", 1.0 * (i % 90), 30.0, 100.0 - (i % 40), 30.0, "shot" if i % 7 == 0 else "pass", "success" if i % 7 == 0 else "fail", None) for i in range(120)]
    events = spark.createDataFrame(rows, "match_id string, seq long, period int, time_seconds double, team_id string, start_x double, start_y double, end_x double, end_y double, action_type string, result string, bodypart string")
    assert [c for c in values.vaep_features(events).columns[2:11]] == ["start_x_oriented", "start_y", "end_x_oriented", "end_y", "distance_to_goal_start", "distance_to_goal_end", "angle_to_goal_start", "period", "time_since_period_start"] and len(values.vaep_features(events).columns) == 27
    models = values.fit_vaep(events)
    assert models["concedes"] == 0.0
    still = events.withColumns({"end_x": F.col("start_x"), "end_y": F.col("start_y")})
    assert values.score_vaep(still, models).filter("abs(vaep_value) > 1e-12").count() == 0
    moved = values.score_vaep(events.withColumns({"start_x": F.col("end_x"), "start_y": F.col("end_y")}), models)
    both = values.score_vaep(events, models).join(moved.select("seq", F.col("p_score_before").alias("p")), "seq")
    assert both.filter("abs(p_score_after - p) > 1e-12").count() == 0
    odd = values.vaep_features(events.limit(1).withColumns({"start_x": F.lit(float("nan")), "time_seconds": F.lit(-3.0)})).first()
    assert odd.start_x_oriented == 0.0 and odd.time_since_period_start == 0.0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_fixture_reaches_all_phases(spark):
    frames = tracking.classify(tracking.frames(tracking.velocities(fixtures.tracking(spark, str(DATA).replace("0.001", "0.01"))))).cache()
    labels = {(r.phase, r.possession_team) for r in frames.select("phase", "possession_team").distinct().collect()}
    assert {p for p, _ in labels} == {"set_piece", "att_transition", "build_up", "progression", "finishing"}
    assert {("build_up", "home"), ("build_up", "away"), ("finishing", "home"), ("finishing", "away")} <= labels
    assert {r.phase for r in tracking.dominant_phases(tracking.episode_frames(frames)).collect()} >= {"att_transition", "progression"}
    out = tracking.outcomes(tracking.episode_frames(frames), tracking.episodes(frames))
    assert out.filter("shot_like").count() and out.filter("not reached_final_third").count() and out.filter("end_reason = 'out_of_play'").count()
