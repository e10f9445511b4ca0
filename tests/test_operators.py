"""Operators on small hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.functions.sequence import sticky
from touchline.operators import credit, retrieval, roles, surfaces, tracking, values


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_geometry_values(spark):
    x, y = G.rescale(F.lit(60.0), F.lit(40.0), 120, 80)
    got = one(spark, x=x, y=y, mid=G.goal_probability(F.lit(94.0), F.lit(34.0)), behind=G.goal_probability(F.lit(106.0), F.lit(34.0)), cell=G.cell(F.lit(105.0), 105.0, 16), low=G.cell(F.lit(-3.0), 105.0, 16))
    assert (got.x, got.y, got.behind, got.cell, got.low) == (52.5, 34.0, 0.0, 15, 0)
    angle = 2 * math.atan(3.66 / 11)
    assert got.mid == pytest.approx(1 / (1 + math.exp(-(1.2 - 0.12 * 11 + 1.5 * angle))), abs=1e-6)


def test_rescale_refuses_unknown_origin(spark):
    with pytest.raises(ValueError):
        G.rescale(F.lit(1.0), F.lit(1.0), 1, 1, "elsewhere")


def test_sticky_ignores_short_changes(spark):
    seen = ["a"] * 3 + ["b"] * 2 + [None] + ["b"] * 3 + ["a"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(seen)], "m int, i int, t string")
    got = [r.out for r in sticky(df, "t", 3, ["m"], ["i"], "out").orderBy("i").collect()]
    assert got == [None, None, "a", "a", "a", "a", "a", "a", "b", "b"]


def test_hull_area(spark):
    points = [(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (2, 0), (4, 3)]
    df = spark.createDataFrame([([float(a) for a, _ in points], [float(b) for _, b in points]), ([1.0], [1.0]), ([], [])], "x array<double>, y array<double>")
    assert [r.a for r in df.select(tracking.hull_area("x", "y").alias("a")).collect()] == [12.0, 0.0, 0.0]


def test_velocity_caps_and_first_frame(spark):
    rows = [("m", 1, k, k / 25, "P1", "home", x, 0.0, False, True) for k, x in enumerate([0.0, 0.2, 5.0])]
    df = spark.createDataFrame(rows, "match_id string, period int, frame_id long, time_seconds double, player_id string, team_id string, x double, y double, is_ball boolean, visible boolean")
    assert [round(r.speed, 6) for r in tracking.velocities(df).orderBy("frame_id").collect()] == [0.0, 5.0, 0.0]


def test_snapshots_are_nearest_frames(spark):
    """Against a plain search for the nearest frame of each target time; target times that two frames are equally near to go to the earlier."""
    n = 53
    df = spark.createDataFrame([("m", 1, 0, k + 1, k * 0.04, 0.0, (n - 1) * 0.04) for k in range(n)], "match_id string, period int, episode_id int, frame_id long, time_seconds double, start_time_s double, end_time_s double")
    length = (n - 1) * 0.04
    count = max(2, round(length * 2) + 1)
    want = {min(range(n), key=lambda k: (round(abs(k * 0.04 - i * length / (count - 1)), 9), k)) + 1 for i in range(count)}
    assert {r.frame_id for r in tracking.snapshots(df).collect()} == want


def test_xt_fixed_point(spark):
    """Two cells: the far one only shoots (half score), the near one always passes there."""
    rows = [("m", 1.0, 1.0, 100.0, 1.0, "pass", "success")] * 3 + [("m", 100.0, 1.0, None, None, "shot", r) for r in ("success", "fail")]
    events = spark.createDataFrame(rows, "match_id string, start_x double, start_y double, end_x double, end_y double, action_type string, result string")
    grid = {(r.r, r.c): r.xt for r in values.fit_xt(events, 1, 2).collect()}
    assert grid == {(0, 0): 0.5, (0, 1): 0.5}
    deltas = values.apply_xt(events, values.fit_xt(events, 1, 2), 1, 2)
    assert deltas.filter("xt_delta is null").count() == 2


def test_control_of_a_lone_team(spark):
    rows = [("m", 1, 1, 0.0, {"x": 50.0, "y": 30.0}, [{"team_id": "home", "player_id": "a", "x": 50.0, "y": 30.0, "vx": 0.0, "vy": 0.0}], "home")]
    frames = spark.createDataFrame(rows, "match_id string, period int, frame_id long, time_seconds double, ball struct<x double, y double>, players array<struct<team_id string, player_id string, x double, y double, vx double, vy double>>, team string")
    got = surfaces.surfaces(frames, 4, 6).agg(F.min("control"), F.count("*")).first()
    assert got[0] > 0.999 and got[1] == 24


def test_nearest_equals_search(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 3)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>").repartition(5)
    got = {(r.query, r["rank"]): r.k for r in retrieval.nearest(rows.filter("k % 4 = 0"), rows, "k", 3, block=4).collect()}
    for q in range(0, 40, 4):
        order = sorted((float(np.sqrt(((v[q] - v[j]) ** 2).sum())), j) for j in range(40) if j != q)
        assert [got[q, i] for i in range(3)] == [j for _, j in order[:3]]


def test_nearest_gives_the_same_rows_in_one_block_and_in_many(spark):
    rows = spark.range(60).selectExpr("id AS k", "array(double(id % 7), double(id % 5)) AS v")
    one, many = (sorted(map(tuple, retrieval.nearest(rows.filter("k % 3 = 0"), rows, "k", 4, block=b).select("query", "k", "distance", "rank").collect())) for b in (1024, 6))
    assert one == many and len(one) == 80
    assert retrieval.nearest(rows.limit(0), rows, "k", 4).count() == 0


def test_density_equals_a_direct_sum(spark):
    import numpy as np

    own = np.random.default_rng(3).normal([60, 30], [12, 9], size=(30, 2)).round(0)
    odd = [("p", None, 1.0), ("p", float("nan"), 1.0), (None, 3.0, 4.0)] + [("few", float(i), float(i * i)) for i in range(4)] + [("line", float(i), 2.0 * i) for i in range(9)]
    points = spark.createDataFrame([("p", float(x), float(y)) for x, y in own] + odd, "player_id string, x double, y double").repartition(3)
    rows = surfaces.density(points, ["player_id"], 9, 11).collect()
    assert {r.player_id for r in rows} == {"p"} and len(rows) == 99 and {r.n for r in rows} == {30}
    cov = np.cov(own.T) * len(own) ** (-1 / 3)
    for r in rows:
        d = np.array([r.c * 10.5, r.r * 8.5]) - own
        assert abs(r.density - np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)).sum() / (30 * 2 * np.pi * np.sqrt(np.linalg.det(cov)))) < 1e-12
    top = max(r.density for r in rows)
    assert surfaces.density(points, ["player_id"], 9, 11, share=0.05).count() == sum(r.density >= 0.05 * top for r in rows)
    assert surfaces.density(points.limit(0), ["player_id"], 9, 11).count() == 0


def test_density_of_many_places_in_many_parts(spark, monkeypatch):
    """Places off the grid, correlated axes, tasks that report often: as near a direct sum as doubles are."""
    import numpy as np

    monkeypatch.setattr(surfaces, "HELD", 20)
    monkeypatch.setattr(surfaces, "RUN", 64)
    rng = np.random.default_rng(8)
    own = np.concatenate([rng.normal([30, 20], [3, 9], size=(700, 2)) @ np.array([[1.0, 0.4], [-0.2, 1.0]]), rng.uniform(0, 60, (100, 2))])
    got = surfaces.density(spark.createDataFrame([("p", float(x), float(y)) for x, y in own], "player_id string, x double, y double").repartition(7), ["player_id"], 23, 31).collect()
    cov = np.cov(own.T) * len(own) ** (-1 / 3)
    at = np.array([[r.c * 3.5, r.r * 68 / 22] for r in got])
    d = at[:, None] - own[None]
    want = np.exp(-0.5 * np.einsum("aij,jk,aik->ai", d, np.linalg.inv(cov), d)).sum(axis=1) / (len(own) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert len(got) == 23 * 31 and np.abs(want - [r.density for r in got]).max() < 1e-14 * want.max() * len(own)


def test_peaks_of_a_batch_equal_the_surface_of_each_frame(spark, monkeypatch):
    """The padded tensor against the column expressions; teams of any size, no ball, and both directions of play."""
    import numpy as np

    monkeypatch.setattr(surfaces, "TENSOR", 500)  # two frames at a time
    rng = np.random.default_rng(2)
    schema = "match_id string, period int, frame_id long, ball struct<x double, y double>, players array<struct<team_id string, player_id string, x double, y double, vx double, vy double>>, team string, right boolean"
    man = lambda team, k: (team, f"{team}{k}", *map(float, rng.uniform(0, 68, 2)), *map(float, rng.normal(0, 3, 2)))
    rows = [("m", 1, i, None if i % 5 == 4 else tuple(map(float, rng.uniform(0, 68, 2))), [man("h", k) for k in range(i % 4)] + [man("a", k) for k in range((i * 7) % 5)], "ha"[i % 2], i % 3 > 0) for i in range(24)]
    frames = spark.createDataFrame(rows, schema)
    want = {}
    for r in surfaces.surfaces(frames, 12, 20).select("frame_id", "r", "c", "obso").collect():
        want[r.frame_id] = max(want.get(r.frame_id, (-1.0, 0, 0)), (round(r.obso, 12), -r.r, -r.c))
    for r in surfaces.with_peak(frames, 12, 20).collect():
        obso, row, col = want[r.frame_id]
        if any(p.team_id == r.team for p in r.players):  # else all values are next to nothing
            assert r.obso_max == pytest.approx(obso, abs=1e-11) and (r.obso_argmax_x, r.obso_argmax_y) == pytest.approx(((0.5 - col) * 105 / 20, (0.5 - row) * 68 / 12))
    turned = frames.withColumns({"ball": F.struct((105.0 - F.col("ball.x")).alias("x"), F.col("ball.y").alias("y")), "players": F.transform("players", lambda p: F.struct(p["team_id"].alias("team_id"), p["player_id"].alias("player_id"), (105.0 - p["x"]).alias("x"), p["y"].alias("y"), (-p["vx"]).alias("vx"), p["vy"].alias("vy")))})
    plain, other = ({r.frame_id: r for r in surfaces.with_peak(x, 12, 20).collect()} for x in (frames, turned))
    for r in surfaces.with_peak(frames, 12, 20, to_right=F.col("right")).collect():
        same = plain[r.frame_id] if r.right else other[r.frame_id]
        assert r.obso_max == pytest.approx(same.obso_max) and r.obso_argmax_x == pytest.approx(same.obso_argmax_x if r.right else 105 - same.obso_argmax_x)
    assert surfaces.with_peak(frames, 12, 20, where=F.lit(False)).filter("obso_max IS NOT NULL").count() == 0


def test_attack_ends_point_one_way(spark):
    rows = spark.createDataFrame([(1, "home", 100.0, 30.0), (2, "away", 5.0, 38.0), (3, "home", 106.0, 30.0), (4, "away", None, None)], "e int, possession_team string, end_ball_x double, end_ball_y double")
    assert [(r.e, r.x, r.y) for r in surfaces.attack_ends(rows).orderBy("e").collect()] == [(1, 100.0, 30.0), (2, 100.0, 30.0)]


TRACKED = "match_id string, period int, frame_id long, time_seconds double, player_id string, team_id string, x double, y double, is_ball boolean, visible boolean"


def delivered(spark, copies):
    """A match of 60 frames, its players alike and its ball elsewhere in each copy."""
    rows = [("m", 1, k, k / 25, f"P{p:02}", "home" if p < 11 else "away", 5.0 + 4 * p + k * 0.1, 3.0 + 2.5 * p, False, True) for k in range(60) for p in range(22)]
    balls = [("m", 1, k, k / 25, None, None, 20.0 + c + k * 0.2, 30.0, True, True) for k in range(60) for c in range(copies)]
    return spark.createDataFrame(rows * copies + balls, TRACKED)


def test_frames_grow_with_distinct_rows_only(spark):
    """Frames that were delivered again neither grow nor change what is read off places."""
    once, again = (tracking.frames(tracking.velocities(delivered(spark, n))) for n in (1, 40))
    assert again.selectExpr("max(size(players))").first()[0] <= 2 * 22
    assert sorted(map(str, tracking.shape(again).collect())) == sorted(map(str, tracking.shape(once).collect()))
    tagged = [f.withColumns({"episode_id": F.lit(0), "team": F.lit("home"), "to_right": F.lit(True), "start_time_s": F.lit(0.0), "end_time_s": F.lit(59 / 25)}) for f in (once, again)]
    mine, theirs = (sorted(map(str, roles.role_trajectory(t).collect())) for t in tagged)
    assert mine == theirs and len(mine) > 0
    assert sorted(map(str, credit.mean_positions(tagged[0]).collect())) == sorted(map(str, credit.mean_positions(tagged[1]).collect()))


def test_velocities_do_not_depend_on_order(spark):
    rows = delivered(spark, 5).filter("is_ball").collect()
    got = [sorted(map(str, tracking.velocities(spark.createDataFrame(r, TRACKED).coalesce(1)).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1]
