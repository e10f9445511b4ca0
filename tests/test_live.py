"""A streamed match gives the episodes, outcomes and phases of the whole table, whatever the cuts between micro-batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline.operators import surfaces, tracking
from touchline.plans import fixtures
from touchline.streaming import live

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames") / "all")
    tracking.frames(tracking.velocities(fixtures.tracking(spark, str(DATA)))).filter("match_id <= 'T01'").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def events(spark, frames, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    for a, b in ((1, 333), (334, 1200), (1201, 2000)):
        frames.filter(F.col("frame_id").between(a, b)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = live.engine(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(f"{folder}/out")


def test_streamed_episodes_equal_whole_table(frames, events):
    classified = tracking.classify(frames).cache()
    whole = tracking.episodes(classified)
    found = tracking.outcomes(tracking.episode_frames(classified), whole)
    key = [*tracking.MATCH, "episode_id"]
    flags = list(live.FLAGS)
    expected = whole.filter("end_reason <> 'match_end'").join(found.select(*key, *flags), key).selectExpr(*key, "start_frame", "end_frame", "possession_team", "end_reason", "duration_s", *flags)
    got = events.filter("kind = 'episode'").selectExpr(*key, "start_frame", "end_frame", "possession_team", "end_reason", "duration_s", *flags)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() > 5
    ticks = events.filter("kind = 'frame'").select(*tracking.FRAME, F.col("phase").alias("p"), F.col("possession_team").alias("t"))
    both = classified.join(ticks, tracking.FRAME)
    assert both.count() == frames.count() and both.filter("not (phase <=> p) or not (possession_team <=> t)").count() == 0


def test_threat_is_that_of_the_surface(frames, events):
    at = events.filter("kind = 'frame' and threat_age_frames = 0").select("match_id", "period", "frame_id", F.col("possession_team").alias("team"), "threat")
    assert at.count() > 50
    assert surfaces.with_peak(frames.join(at, tracking.FRAME)).filter("abs(obso_max - threat) > 1e-9").count() == 0


def test_predictions_and_calibration(spark, events):
    names = [f"f{i}" for i in range(24)]
    due = events.filter("kind = 'frame' and features is not null")
    library = due.select(F.col("frame_id").alias("key"), *[F.col("features")[i].alias(n) for i, n in enumerate(names)], (F.col("frame_id") % 2 == 0).alias("reached_final_third"), F.lit(False).alias("ended_in_box"), F.lit(True).alias("shot_like"))
    got = live.predictions(events, library, names)
    rows = got.collect()
    assert len(rows) == due.count() and {r.confidence for r in rows} <= {"high", "medium", "low"}
    assert all(r.p_shot_like == 1.0 and r.p_ended_in_box == 0.0 and len(r.neighbours) == 3 for r in rows)
    logged = live.calibration(got, events)
    assert logged.count() == len(rows) and logged.filter("realised_shot_like is null").count() > 0 and logged.filter("realised_shot_like is not null").count() > 0
