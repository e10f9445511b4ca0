"""Credit, attribution, texts, recommendations and clusters against small cases worked by hand and plain recursions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import credit, retrieval, similarity, surfaces, tracking

SCHEMA = "match_id string, period int, episode_id int, frame_id long, time_seconds double, start_time_s double, end_time_s double, team string, to_right boolean, ball struct<x:double,y:double,vx:double,vy:double>, players array<struct<team_id:string,player_id:string,x:double,y:double,vx:double,vy:double,speed:double>>"


def row(k, ball, own, other=((60.0, 30.0),), episode=0):
    people = [("home", f"h{i}", *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(own)] + [("away", f"a{i}", *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(other)]
    return ("m", 1, episode, k, k / 2, 0.0, 2.0, "home", True, ball, people)


def test_credit_of_steps(spark):
    rows = [row(0, (50.0, 30.0, 0.0, 0.0), [(50, 31), (50, 38), (20, 5)]), row(1, None, [(50, 31)]), row(2, (50.0, 30.0, 0.0, 0.0), [(50, 35), (50, 31)]), row(3, (50.0, 30.0, 0.0, 0.0), [(50, 31)])]
    threat = spark.createDataFrame(rows, SCHEMA).withColumn("obso_max", F.element_at(F.array(*map(F.lit, (0.1, 0.4, 0.2, 0.3))), (F.col("frame_id") + 1).cast("int")))
    got = {r.player_id: r for r in credit.td_credit(threat).collect()}
    assert set(got) == {"h0", "h1"}  # h2 is never involved; the step from the frame without a ball credits nobody
    assert (got["h0"].credit, got["h0"].n_snapshots_carrier, got["h0"].n_snapshots_near_ball) == (pytest.approx(0.3 + 0.3 * 0.1), 1, 1)
    assert (got["h1"].credit, got["h1"].rank) == (pytest.approx(0.3 * 0.3 + 0.1), 2)
    assert credit.td_credit(threat.filter("frame_id = 0")).count() == 0
    label = spark.createDataFrame([("m", 1, 0, 4)], "match_id string, period int, episode_id int, cluster int")
    assert {(r.cluster, r.player_id): round(r.credit, 6) for r in credit.pattern_credit(credit.td_credit(threat), label).collect()} == {(4, "h0"): 0.33, (4, "h1"): 0.19}


def test_leave_one_out_and_text(spark):
    frames = spark.createDataFrame([row(0, (80.0, 34.0, 0.0, 0.0), [(40, 34), (30, 10)]), row(1, (90.0, 34.0, 0.0, 0.0), [(88, 34), (30, 10)])], SCHEMA)
    peaks = spark.createDataFrame([("m", 1, 0, 1)], "match_id string, period int, episode_id int, peak_frame long")
    got = {r.player_id: r for r in credit.leave_one_out(frames, peaks, 20, 30).collect()}
    assert got["h1"].contribution == 0.0 and got["h0"].contribution > 0.01
    moved = spark.createDataFrame([row(1, (90.0, 34.0, 0.0, 0.0), [(64, 34), (30, 10)])], SCHEMA)
    assert got["h0"].baseline_obso == pytest.approx(surfaces.with_peak(moved, 20, 30).first().obso_max)
    cells = surfaces.surfaces(frames.filter("frame_id = 1"), 20, 30)
    assert got["h0"].peak_obso == pytest.approx(cells.agg(F.max("obso")).first()[0])
    rows = spark.createDataFrame([("m", 1, 0, 0, 1, 0.0, 2.0, 2.0, "home", "out_of_play")], "match_id string, period int, episode_id int, start_frame long, end_frame long, start_time_s double, end_time_s double, duration_s double, possession_team string, end_reason string")
    found = spark.createDataFrame([("m", 1, 0, "out_of_play", 2.0, True, True, False)], "match_id string, period int, episode_id int, end_reason string, duration_s double, reached_final_third boolean, ended_in_box boolean, shot_like boolean")
    triggers = spark.createDataFrame([("m", 1, 0, 0, 0.0)], "match_id string, period int, episode_id int, trigger_frame long, trigger_time_s double")
    told = credit.narratives(rows, found, triggers, credit.leave_one_out(frames, peaks, 20, 30)).first()
    assert told.top_contributors == ["h0", "h1"] and told.text.startswith("home on the ball for 2.00 s (0.0 to 2.0 s); into the last third at 0.0 s; closed in the box. Best chance ")
    plain = credit.narratives(rows, found, triggers, credit.leave_one_out(frames, peaks.limit(0), 20, 30)).first()
    assert plain.text == "home on the ball for 2.00 s (0.0 to 2.0 s); into the last third at 0.0 s; closed in the box." and plain.top_contributors == []


def test_holders_and_trails(spark):
    def at(k, d0, d1):
        return row(k, (50.0, 30.0, 0.0, 0.0), [(50 + d0, 30)], [(50, 30 + d1)])

    frames = spark.createDataFrame([at(0, 1, 3), at(1, 3, 1), at(2, 3, 1), at(3, 3, 2.8), at(4, 3, 1), at(5, 3, 1), at(6, 3, 1), at(7, 3, 1)], SCHEMA)
    got = [r.holder for r in credit.smoothed_holders(frames).orderBy("frame_id").collect()]
    assert got == ["h0"] * 7 + ["a0"]  # the doubtful frame 3 starts the count again
    assert [len(r.trail) for r in credit.trails(frames, 3).orderBy("frame_id").collect()] == [1, 2, 3, 3, 3, 3, 3, 3]


def plain_soft_dtw(a, b, gamma):
    total = {(-1, -1): 0.0}
    get = lambda i, j: total.get((i, j), math.inf)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        ways = [w for w in (get(i - 1, j - 1), get(i - 1, j), get(i, j - 1)) if w < math.inf]
        total[i, j] = float(((a[i] - b[j]) ** 2).sum()) - gamma * math.log(sum(math.exp(-w / gamma) for w in ways))
    return total[len(a) - 1, len(b) - 1]


def test_soft_dtw_equals_recursion():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (4, 3), (6, 6)):
        a, b = rng.random((n, 4)), rng.random((m, 4))
        assert similarity.soft_dtw(a, b, 0.7) == pytest.approx(plain_soft_dtw(a, b, 0.7))
    with pytest.raises(ValueError):
        similarity.soft_dtw(np.zeros((2, 2)), np.zeros((2, 3)))
    with pytest.raises(ValueError):
        similarity.soft_dtw(np.zeros((2, 2)), np.zeros((2, 2)), 0.0)


def test_density_clusters_and_stability(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.2, (9, 2)), rng.normal(8, 0.2, (8, 2)), [[30.0, -30.0]]])
    square = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    labels = similarity.density_labels(square)
    assert len(set(labels[:9])) == 1 and len(set(labels[9:17])) == 1 and labels[0] != labels[9] and labels[17] == -1 and labels[0] >= 0 and labels[9] >= 0
    assert similarity.density_labels(np.zeros((0, 0))).tolist() == [] and similarity.density_labels(np.zeros((1, 1))).tolist() == [-1]
    rows = spark.createDataFrame([("m", i, [float(x) for x in p]) for i, p in enumerate(points)], "match_id string, e int, v array<double>")
    paths = spark.createDataFrame([("m", i, [[float(x) for x in p]]) for i, p in enumerate(points) if i != 3], "match_id string, e int, path array<array<double>>")
    pairs = similarity.fused(similarity.episode_pairs(rows, paths, ["match_id"], ["match_id", "e"]), ["match_id"], 1.0, 0.0)
    assert pairs.count() == 18 * 17 / 2
    top = pairs.filter("a.e = 3 or b.e = 3").agg(F.min("path_far")).first()[0]
    assert top == pytest.approx(pairs.filter("a.e <> 3 and b.e <> 3").agg(F.max("path_far")).first()[0] + 1)
    got = {r.e: r.cluster for r in similarity.density_clusters(pairs, ["match_id"], ["match_id", "e"]).collect()}
    assert [got[i] for i in range(18)] == labels.tolist()
    assert {(r.n, r.stable) for r in similarity.stability(pairs, ["match_id"]).collect()} == {(9, True), (8, True)}


def test_members_and_membership(spark):
    labelled = spark.createDataFrame([("m", 1, 0), ("m", 2, -1), ("n", 1, 0), ("n", 3, 2)], "match_id string, e int, cluster int")
    assert sorted(map(tuple, retrieval.members(labelled, ["match_id", "e"]).collect())) == [(0, "m", 1), (0, "n", 1), (2, "n", 3)]
    asked = spark.createDataFrame([("m", 1), ("m", 2), ("z", 9)], "match_id string, e int")
    assert {(r.match_id, r.e): r.cluster for r in retrieval.cluster_of(asked, labelled, ["match_id", "e"]).collect()} == {("m", 1): 0, ("m", 2): None, ("z", 9): None}


def test_overlaps_mixes_and_profiles(spark):
    """Set overlap, clusters by source and in words, the share of foreign neighbours, predictions and tails of movement."""
    sets = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in sets.select(retrieval.jaccard("a", "b")).collect()] == [0.5, 0.0]
    rows = [(0, "s", "build_up", True, False), (0, "t", "build_up", True, True), (0, "s", "finishing", False, False), (1, "t", "finishing", False, True)]
    labelled = spark.createDataFrame(rows, "cluster int, source string, phase string, reached_final_third boolean, shot_like boolean")
    assert sorted(map(tuple, retrieval.source_mix(labelled).collect())) == [(0, "s", 2), (0, "t", 1), (1, "t", 1)]
    assert {r.cluster: r.label for r in retrieval.cluster_profiles(labelled).collect()} == {0: "build_up, 3 episodes, 67% final third, 33% shots", 1: "finishing, 1 episodes, 0% final third, 100% shots"}
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.5), (2, 1, 0.5)], "query int, k int, distance double")
    sources = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "k int, source string")
    assert {r.query: r.cross_source for r in retrieval.cross_source_rate(near, sources, "k").collect()} == {1: 0.5, 2: 0.0}
    outcomes = spark.createDataFrame([(1, True, False, False), (2, True, True, False), (3, False, True, True)], "k int, reached_final_third boolean, ended_in_box boolean, shot_like boolean")
    got = {r.query: (r.p_reached_final_third, r.p_ended_in_box, r.p_shot_like, r.max_distance) for r in retrieval.predict(near, outcomes, "k").collect()}
    assert got == {1: (0.5, 1.0, 0.5, 1.5), 2: (1.0, 0.0, 0.0, 0.5)}


def test_recommendations(spark):
    schema = "match_id string, period int, episode_id int, cluster int, phase string, shot_like boolean, ended_in_box boolean, reached_final_third boolean, duration_s double"
    rows = [("m", 1, i, i % 2, "build_up", i % 2 == 0, i % 2 == 0, True, 0.0) for i in range(8)] + [("m", 1, 8, 2, "build_up", True, True, True, 0.0)]
    labelled = spark.createDataFrame(rows, schema)
    pairs = spark.createDataFrame([("m", 1, i, "4-3-3", "4-4-2" if i < 7 else "4-3-3") for i in range(9)], "match_id string, period int, episode_id int, attacker_formation string, defender_formation string")
    got = [(r["rank"], r.cluster, r.n, r.n_cluster, r.value, [e.episode_id for e in r.examples]) for r in retrieval.recommend(labelled, pairs, defender="4-4-2").orderBy("rank").collect()]
    assert got == [(0, 0, 4, 4, 1.0, [0, 2, 4]), (1, 1, 3, 4, 0.3, [1, 3, 5])]
    assert retrieval.recommend(labelled, pairs, defender="4-2-3-1").count() == 0
    assert [(r.defender_formation, r.n) for r in retrieval.recommend_defence(labelled, pairs, "4-3-3").collect()] == [("4-4-2", 7)]


def test_pressing_features(spark):
    frames = spark.createDataFrame([row(0, (50.0, 30.0, 0.0, 0.0), [(72, 30), (76, 33)], [(54, 33), (50, 38)]), row(1, None, [(72, 30)])], SCHEMA)
    played = spark.createDataFrame([("m", 1, 0, 0, 3.0), ("m", 1, 0, 0, 1.0), ("m", 1, 0, 1, 5.0)], "match_id string, period int, episode_id int, frame_id long, displacement double")
    r = tracking.pressing_features(frames, played).first()
    assert (r.pressing_mean, r.pressing_min, r.defenders_within_5m, r.defenders_within_10m) == (5.0, 5.0, 1.0, 2.0)
    assert (r.formation_match_cost, r.mean_role_displacement, r.attackers_in_third) == (4.0, 3.0, 2.0) and r.attackers_spread == pytest.approx(2.5)
