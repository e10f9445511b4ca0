"""Matches with typed state: the same rows as the whole table's, through restarts in mid-episode, late frames and silence."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline.operators import credit, tracking
from touchline.plans import fixtures
from touchline.streaming import live, matches

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
NAMES = [f"f{i}" for i in range(24)]
KEY = [*tracking.MATCH, "episode_id"]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames") / "all")
    rows = tracking.frames(tracking.velocities(fixtures.tracking(spark, str(DATA)))).filter("match_id <= 'T01'")
    rows.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id") / 25)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame([(i, *[float((i * 7 + c) % 5) for c in range(24)], i % 2 == 0, False, True) for i in range(20)], ", ".join(["key long", *[f"{n} double" for n in NAMES], *[f"{f} boolean" for f in live.FLAGS]]))


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(matches.STORE[0])
    spark.conf.set(*matches.STORE)
    yield
    spark.conf.set(matches.STORE[0], old)


def play(spark, folder, parts, library=None, once=True, **options):
    """Runs the engine over files of frames, all in one query or each in a query of its own that goes on from the checkpoint."""
    out = None
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if once and k + 1 < len(parts):
            continue
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = matches.engine(stream, library, NAMES if library is not None else None, **options).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination(300)
        out = [p for p in query.recentProgress]
    return spark.read.parquet(f"{folder}/out"), out


def between(frames, *cuts):
    return [frames.filter(F.col("frame_id").between(a, b)) for a, b in cuts]


def test_rows_equal_the_whole_table_and_survive_restarts(spark, frames, library, rocks, tmp_path):
    cuts = between(frames, (1, 333), (334, 1200), (1201, 2000))
    options = {"attribute_from": 0.0, "abandon_s": 3600}
    one, _ = play(spark, tmp_path / "one", cuts, library, **options)
    many, _ = play(spark, tmp_path / "many", cuts, library, once=False, **options)
    columns = [c for c in one.columns if c not in ("players", "means", "ball")]
    assert one.count() > 4000 and sorted(map(repr, one.select(columns).collect())) == sorted(map(repr, many.select(columns).collect()))
    classified = tracking.classify(frames).cache()
    whole, flags = tracking.episodes(classified), list(live.FLAGS)
    inside = tracking.episode_frames(classified)
    found = tracking.outcomes(inside, whole)
    names = [*KEY, "start_frame", "end_frame", "possession_team", "end_reason", "duration_s", *flags]
    expected = whole.filter("end_reason <> 'match_end'").join(found.select(*KEY, *flags), KEY).select(names)
    assert sorted(map(tuple, many.filter("kind = 'episode'").select(names).collect())) == sorted(map(tuple, expected.collect()))
    ticks = many.filter("kind = 'frame'").select(*tracking.FRAME, F.col("phase").alias("p"), F.col("possession_team").alias("t"))
    both = classified.join(ticks, tracking.FRAME)
    assert both.count() == frames.count() and both.filter("not (phase <=> p) or not (possession_team <=> t)").count() == 0
    # predictions: each is resolved once, when its episode ends, by that episode's flags
    predicted, resolved = many.filter("kind = 'prediction'").drop(*flags), matches.calibration(many)
    closed = predicted.join(many.filter("kind = 'episode'").select(*KEY, *flags), KEY)
    assert predicted.count() > resolved.count() == closed.count() > 20
    right = resolved.join(closed.select(*tracking.FRAME, *flags, F.col("max_distance").alias("d")), tracking.FRAME)
    assert right.count() == resolved.count() and right.filter(" or ".join(f"realised_{f} <> {f}" for f in flags) + " or d <> max_distance").count() == 0
    assert predicted.filter("size(neighbours) <> 3 or p_shot_like <> 1 or p_ended_in_box <> 0").count() == 0
    # credit at a frame is that of the whole table's rows up to there; at most one frame in five
    asked = many.filter("kind = 'attribution'").select(*KEY, "frame_id").orderBy("frame_id", "match_id").collect()
    assert asked and len({(r.match_id, r.period, r.frame_id // 5) for r in asked}) == len(asked)
    got = {(r.match_id, r.episode_id, r.peak_frame, r.player_id): r.contribution for r in matches.attributions(many, (10, 15)).collect()}
    for r in (asked[3], asked[len(asked) // 2]):
        seen = inside.filter((F.col("match_id") == r.match_id) & (F.col("episode_id") == r.episode_id) & (F.col("period") == r.period) & (F.col("frame_id") <= r.frame_id))
        peaks = spark.createDataFrame([(r.match_id, r.period, r.episode_id, r.frame_id)], "match_id string, period int, episode_id int, peak_frame long")
        want = credit.leave_one_out(seen, peaks, 10, 15).collect()
        assert want and all(got[w.match_id, w.episode_id, w.peak_frame, w.player_id] == pytest.approx(w.contribution, abs=1e-9) for w in want)


def test_late_frames_are_counted_and_silent_matches_closed(spark, frames, rocks, tmp_path):
    first = frames.filter("match_id = 'T00' and period = 1 and frame_id <= 400")
    again = first.filter("frame_id between 391 and 400")  # not later than the last, but within the watermark's delay
    old = first.filter("frame_id <= 7")
    other = frames.filter("match_id = 'T01' and period = 1 and frame_id between 301 and 900")
    later = frames.filter("match_id = 'T01' and period = 1 and frame_id between 901 and 910")
    rows, progress = play(spark, tmp_path / "late", [first, again, other, old, later], abandon_s=5, attribute_from=9.0)
    assert [(r.match_id, r.n_late) for r in rows.filter("kind = 'late'").collect()] == [("T00", 10)]
    assert sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"]) == 7
    closed = rows.filter("kind = 'episode' and match_id = 'T00' and end_reason = 'match_end'").collect()
    assert len(closed) == 1 and closed[0].end_frame == 400
    assert rows.filter("kind = 'frame' and match_id = 'T00'").count() == 400
    assert {r.neighbours for r in rows.collect()} == {None}


def test_another_store_is_refused(spark, frames, tmp_path):
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        matches.engine(stream)
