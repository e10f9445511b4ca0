"""Provider documents, the lake and the contracts on small files that the tests write."""

import datetime
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.sources import contracts, lake, providers


def event(kind, i, team=1, period=1, location=(60.0, 40.0), **more):
    return {"id": f"e{i}", "type": {"id": 1, "name": kind}, "team": {"id": team, "name": "t"}, "player": {"id": 9, "name": "p"}, "location": list(location) if location else None, "period": period, "minute": 1, "second": i, **more}


@pytest.fixture
def raw(spark, tmp_path):
    rows = [
        event("Pass", 0, **{"pass": {"end_location": [120.0, 80.0], "body_part": {"name": "Right Foot"}}}), event("Pass", 1, team=2, **{"pass": {"end_location": [90.0, 20.0], "outcome": {"name": "Pass Offside"}}}),
        event("Shot", 2, **{"shot": {"end_location": [120.0, 40.0, 2.1], "body_part": {"name": "Head"}, "outcome": {"name": "Goal"}}}), event("Shot", 3, period=2, **{"shot": {"end_location": [120.0, 40.0]}}),
        event("Carry", 4, carry={"end_location": [61.0, 40.0]}), event("Dribble", 5, dribble={"outcome": {"name": "Complete"}}), event("Dribble", 6), event("Foul Committed", 7, foul_committed={"card": {"name": "Second Yellow"}}),
        event("Foul Committed", 8), event("Duel", 9, location=None), event("Half Start", 10),
    ]
    path = tmp_path / "77.json"
    path.write_text(json.dumps(rows))
    return providers.read_json(spark, str(path), providers.EVENTS_JSON).withColumn("match_id", providers.match_key("statsbomb", F.col("file")))


def test_events_become_actions(spark, raw):
    homes = spark.createDataFrame([("statsbomb:77", "1")], "match_id string, home_team_id string")
    got = {r.raw_event_id: r for r in providers.actions(raw, homes).collect()}
    assert len(got) == 10 and got["e0"].match_id == "statsbomb:77"
    assert [got[f"e{i}"].result for i in range(10)] == ["success", "offside", "success", "fail", "success", "success", "fail", "yellow_card", "fail", None]
    assert (got["e0"].start_x, got["e0"].start_y, got["e0"].end_x, got["e0"].end_y, got["e0"].bodypart, got["e0"].time_seconds) == (52.5, 34.0, 105.0, 0.0, "right_foot", 60.0)
    assert (got["e1"].end_x, got["e1"].end_y) == (26.25, 17.0)  # the away team's points are mirrored
    assert (got["e3"].end_x, got["e3"].end_y) == (0.0, 34.0)  # as all are in the second period
    assert got["e9"].start_x is None and got["e9"].end_x is None and got["e5"].end_x == got["e5"].start_x and got["e2"].bodypart == "head"
    assert contracts.violation_counts(contracts.conform(providers.actions(raw, homes), contracts.ACTIONS_SCHEMA), contracts.ACTION_RULES).count() == 0
    with pytest.raises(PySparkException):
        providers.actions(raw, homes.filter("false")).collect()


def test_names_and_homes(spark):
    lineups = spark.createDataFrame([(1, "t", [(5, "Long Name", "Nick"), (6, "Only Name", None), (7, None, " ")])], providers.LINEUPS_JSON)
    assert {r.player_id: r.name for r in providers.player_names(lineups).collect()} == {"5": "Nick", "6": "Only Name", "7": "7"}
    matches = spark.createDataFrame([(3, "d", (11, "a"), (12, "b"), None, None)], providers.MATCHES_JSON)
    assert [tuple(r) for r in providers.home_teams(matches).collect()] == [("statsbomb:3", "11")]


def test_unit_square_tracking(spark):
    df = spark.createDataFrame([("metrica:1", 1, k, k / 25, 0.5, 0.25, None if k else 0.1, 0.2, float("nan"), 0.5) for k in range(4)], "match_id string, period int, frame_id long, time_seconds double, ball_x double, ball_y double, P1_x double, P1_y double, P2_x double, P2_y double")
    got = providers.unit_to_long(df, {"P1": "home", "P2": "away"}, every=2).orderBy("frame_id", "is_ball").collect()
    assert [(r.frame_id, r.player_id, r.x, r.y, r.is_ball) for r in got] == [(0, "P1", 10.5, pytest.approx(54.4), False), (0, None, 52.5, 51.0, True), (2, None, 52.5, 51.0, True)]


def test_lines_tracking(spark, tmp_path):
    match = spark.createDataFrame([("skillcorner:9", (1,), (2,), [(10, 1), (20, 2), (30, 3)])], "match_id string, home_team struct<id:long>, away_team struct<id:long>, players array<struct<id:long,team_id:long>>")
    frames = [
        {"frame": 1, "timestamp": "00:00:01.50", "period": 1, "ball_data": {"x": 0.0, "y": 1.0, "is_detected": True}, "player_data": [{"player_id": 10, "x": -2.5, "y": 0.0, "is_detected": False}, {"player_id": 30, "x": 0.0, "y": 0.0}]},
        {"frame": 2, "timestamp": "00:01.60", "period": 1, "ball_data": {"x": None, "y": None, "is_detected": True}, "player_data": [{"player_id": 20, "x": 1.0, "y": 1.0}]},
        {"frame": 3, "timestamp": None, "period": 1}, {"frame": 4, "timestamp": "00:05.0", "period": None}, {"frame": 5, "timestamp": "soon", "period": 1},
    ]
    path = tmp_path / "9.jsonl"
    path.write_text("\n".join(map(json.dumps, frames)))
    rows = providers.read_json(spark, str(path), providers.FRAMES_JSON, lines=True).withColumn("match_id", providers.match_key("skillcorner", F.col("file")))
    got = providers.lines_to_long(rows, providers.roster(match)).orderBy("frame_id", "is_ball").collect()
    assert [(r.frame_id, r.time_seconds, r.player_id, r.team_id, r.x, r.y, r.visible) for r in got] == [(1, 1.5, "10", "home", 50.0, 34.0, False), (1, 1.5, None, None, 52.5, 35.0, True), (2, 1.6, "20", "away", 53.5, 35.0, True), (2, 1.6, None, None, None, None, False)]


def test_clips_from_an_archive(spark, tmp_path):
    mark = lambda i, cat, x, team=None, t="4": {"image_id": i, "category_id": cat, "track_id": t, "bbox_pitch": {"x_bottom_middle": x, "y_bottom_middle": 0.0}, "attributes": {"team": team}}
    clip = {"info": {"frame_rate": 10.0}, "images": [{"image_id": "a"}, {"image_id": "b"}], "annotations": [mark("b", 1, 1.5, "left"), mark("a", 2, 2.0, "right", "5"), mark("a", 4, 0.0), mark("a", 3, 0.0), mark("a", 1, 0.0), mark("a", 1, 99.0, "left"), mark("z", 1, 0.0, "left")]}
    with zipfile.ZipFile(tmp_path / "train.zip", "w") as z:
        z.writestr("train/SN-1/Labels-GameState.json", json.dumps(clip))
    got = providers.clips_to_long(providers.read_clips(spark, str(tmp_path / "train.zip"))).orderBy("frame_id", "is_ball").collect()
    assert [(r.match_id, r.frame_id, r.time_seconds, r.player_id, r.team_id, r.x, r.is_ball) for r in got] == [("soccernet:SN-1", 1, 0.0, "track-5", "away", 54.5, False), ("soccernet:SN-1", 1, 0.0, None, None, 52.5, True), ("soccernet:SN-1", 2, 0.1, "track-4", "home", 54.0, False)]
    assert [r.s for r in spark.createDataFrame([("soccernet:x",), ("other",), ("metrica:1",)], "m string").select(providers.source_of(F.col("m")).alias("s")).collect()] == ["SoccerNet", "unknown", "Metrica"]


def test_violations(spark):
    df = spark.createDataFrame([("m", 6, 0, 1.0, None, None, 130.0, 1.0, True, True), ("m", 1, 0, -1.0, None, None, None, None, None, True), ("m", 1, 0, 1.0, "p", "t", 1.0, 1.0, False, True)], contracts.TRACKING_SCHEMA)
    assert sorted(map(tuple, contracts.violation_counts(df, contracts.TRACKING_RULES).collect())) == [("is_ball", "null", 1), ("period", "range", 1), ("time_seconds", "range", 1), ("x", "range", 1)]
    assert sorted(len(r.broken) for r in contracts.violations(df, contracts.TRACKING_RULES).collect()) == [2, 2]
    assert contracts.violation_counts(df.filter("false"), contracts.TRACKING_RULES).count() == 0


def test_lake(spark, raw, tmp_path):
    homes = spark.createDataFrame([("statsbomb:77", "1")], "match_id string, home_team_id string")
    rows, root = providers.actions(raw, homes), str(tmp_path / "lake")
    assert lake.register_views(spark, root) == []
    lake.write_actions(rows, root, "c", "s")
    lake.write_actions(rows.limit(3).withColumn("match_id", F.lit("statsbomb:78")), root, "c", "s")
    lake.write_actions(rows, root, "c", "s")  # again: replaces its own match only
    assert {r.match_id: r["count"] for r in lake.read_corpus(spark, root).groupBy("match_id").count().collect()} == {"statsbomb:77": 10, "statsbomb:78": 3}
    assert lake.read_corpus(spark, root, min_rows=5).count() == 10 and lake.read_corpus(spark, root, match_ids=["statsbomb:78"]).count() == 3
    assert lake.register_views(spark, root) == ["events"] and spark.sql("SELECT count(*) FROM events").first()[0] == 13
    log = lambda m, h, day: spark.createDataFrame([("statsbomb", m, h, 1, lake.SCHEMA_VERSION, datetime.datetime(2024, 1, day))], lake.LOG_SCHEMA)
    for x in (("77", "a", 1), ("78", "b", 2), ("77", "c", 3)):
        lake.record_ingest(spark, root, log(*x))
    assert [(r.match_id, r.content_hash) for r in lake.ingest_log(spark, root, "statsbomb").collect()] == [("77", "c"), ("78", "b")]
    assert lake.ingest_log(spark, root, "other").count() == 0


def test_cache_is_valid_for_its_inputs_only(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    (source / "a.txt").write_text("one")
    now = lake.inputs_hash(spark, str(source))
    assert lake.read_cache(spark, path, "1", now) is None
    lake.write_cache({"t": spark.range(3)}, path, "1", now)
    assert lake.read_cache(spark, path, "1", now)["t"].count() == 3 and lake.read_cache(spark, path, "2", now) is None
    (source / "b.txt").write_text("two")
    assert lake.inputs_hash(spark, str(source)) != now
    import hashlib

    assert {r.file: r.content_hash for r in lake.content_hashes(spark, str(source)).collect()}["a.txt"] == hashlib.sha256(b"one").hexdigest()[:16]
