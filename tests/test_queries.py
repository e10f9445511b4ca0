"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

from touchline.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    found = plans.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    mine = sorted(map(repr, found.select(*columns).toArrow().to_pylist()))
    theirs = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()[name]})").to_arrow_table().to_pylist()))
    assert mine == theirs


def test_entry_module_registers_all():
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def shared_ids(tmp_path_factory):
    """Matches 10, 100 and 104 (all T10) and 11, 400 frames of each."""
    folder = tmp_path_factory.mktemp("shared")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"COPY (SELECT * REPLACE (m * 2000 + k AS event_id) FROM (SELECT * FROM '{DATA}/events.parquet' LIMIT 1), (SELECT unnest([10, 100, 104, 11]) AS m), range(400) t(k)) TO '{folder}/events.parquet'")
    c.execute(f"COPY (FROM '{DATA}/nation.parquet') TO '{folder}/nation.parquet'")
    for t in ("events", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", ["ball_holders", "smoothed_holders", "possession"])
def test_rows_equal_sql_where_matches_share_an_id(spark, shared_ids, name):
    duck, folder = shared_ids
    found = plans.queries()[name](spark, folder)
    columns = sorted(found.columns)
    mine = sorted(map(repr, found.select(*columns).toArrow().to_pylist()))
    theirs = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()[name]})").to_arrow_table().to_pylist()))
    assert mine == theirs and len(mine) > 700


def test_phases_of_shared_ids(spark, shared_ids):
    """The SQL leaves the order of balls in a frame open; what it makes of given phases isn't, nor is the number of rows."""
    duck, folder = shared_ids
    rows = plans._classified_balls(spark, folder).select("match_id", "period", "frame_id", "time_seconds", "phase").cache()
    phased = rows.toArrow()  # noqa: F841
    duck.register("given", phased)
    body = plans._SQL["phase_segments"][0].replace("FROM phased", "FROM (SELECT * RENAME (time_seconds AS t) FROM given)")
    found = plans.rounded(plans.tracking.phase_segments(rows))
    columns = sorted(found.columns)
    want = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({body})").to_arrow_table().to_pylist()))
    assert sorted(map(repr, found.select(*columns).toArrow().to_pylist())) == want
    n = duck.execute(f"SELECT count(*) FROM ({plans.oracle_sql()['phases']})").fetchone()[0]
    assert plans.phases(spark, folder).count() == n == rows.count() > 1000


def test_phase_runs_keep_a_frame_together(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "b"), (3, 0, "b"), (3, 1, "a"), (4, 0, "a")]
    df = spark.createDataFrame([("m", 1, f, b, f / 25, p) for f, b, p in rows], "match_id string, period int, frame_id long, ball_no int, time_seconds double, phase string")
    got = sorted((r.phase, r.start_frame, r.end_frame, r.n_frames) for r in plans.tracking.phase_runs(df).collect())
    assert got == [("a", 1, 1, 1), ("a", 3, 4, 2), ("b", 1, 2, 3), ("b", 3, 3, 1)]


def test_episodes_of_frames_with_several_balls(spark):
    from pyspark.sql import functions as F

    rows = [("m", 1, f, b, f / 25, "home" if f < 21 or (f == 21 and b == 0) else "away", {"x": 50.0, "y": 30.0 + b}) for f in range(1, 61) for b in range(2)]
    smooth = spark.createDataFrame(rows, "match_id string, period int, frame_id long, ball_no int, time_seconds double, possession_team string, ball struct<x double, y double>")
    tagged = plans.tracking.episode_frames(smooth).cache()
    got = sorted((r.episode_id, r.team, r.a, r.b, r.n) for r in tagged.groupBy("episode_id", "team").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"), F.count("*").alias("n")).collect())
    assert got == [(0, "home", 1, 20, 40), (1, "home", 21, 21, 1), (2, "away", 21, 60, 79)]
    pick = lambda rows: sorted((r.episode_id, r.frame_id) for r in plans.tracking.snapshots(rows).select("episode_id", "frame_id").distinct().collect())
    single = tagged.dropDuplicates(["episode_id", "frame_id"]).drop("ball_no")
    assert pick(tagged) == pick(single) and len(pick(tagged)) == 8


def test_snapshots_of_shared_ids(spark, shared_ids):
    """Each once, though the frames have several rows; frames of T11, which has one match, are the SQL's."""
    duck, folder = shared_ids
    for name, columns in (("snapshots", "period, episode_id, frame_id"), ("dominant_phases", "period, episode_id, phase")):
        found = plans.queries()[name](spark, folder)
        mine = [tuple(r) for r in found.filter("match_id = 'T11'").selectExpr(*columns.split(", ")).collect()]
        assert sorted(mine) == sorted(duck.execute(f"SELECT {columns} FROM ({plans.oracle_sql()[name]}) WHERE match_id = 'T11'").fetchall()) and mine
        assert found.count() == found.distinct().count()


def in_order(sql):
    """The SQL with its ties in the code's order: balls of a frame by place and velocity, episodes of one start by end and team."""
    ball = "frame_id, bno"
    for a, b in (
        ("coalesce(player_id, 'BALL') ORDER BY frame_id)", "coalesce(player_id, 'BALL') ORDER BY frame_id, x NULLS FIRST, y NULLS FIRST)"),
        ("vy AS bvy FROM fast", "vy AS bvy, row_number() OVER (PARTITION BY match_id, period, frame_id ORDER BY x, y, vx, vy) AS bno FROM fast"),
        ("SELECT f.*, bx, b_y, bvx, bvy FROM", "SELECT f.*, bx, b_y, bvx, bvy, bno FROM"),
        ("WINDOW w AS (PARTITION BY match_id, period ORDER BY frame_id))", f"WINDOW w AS (PARTITION BY match_id, period ORDER BY {ball}))"),
        ("(PARTITION BY match_id, period ORDER BY frame_id ROWS UNBOUNDED PRECEDING)", f"(PARTITION BY match_id, period ORDER BY {ball} ROWS UNBOUNDED PRECEDING)"),
        ("(PARTITION BY match_id, period, run ORDER BY frame_id)", f"(PARTITION BY match_id, period, run ORDER BY {ball})"),
        ("lag(possession_team) OVER (PARTITION BY match_id, period ORDER BY frame_id)", f"lag(possession_team) OVER (PARTITION BY match_id, period ORDER BY {ball})"),
        ("(PARTITION BY match_id, period, live ORDER BY frame_id ROWS", f"(PARTITION BY match_id, period, live ORDER BY {ball} ROWS"),
        ("ORDER BY start_frame) - 1", "ORDER BY start_frame, end_frame, team) - 1"),
        ("list(next_dead ORDER BY frame_id DESC)", "list(next_dead ORDER BY frame_id DESC, bno DESC)"),
        ("episode_id ORDER BY frame_id DESC) = 1", "episode_id ORDER BY frame_id DESC, bno DESC) = 1"),
        ("CASE WHEN v < 12 THEN -v ELSE 0 END, frame_id)", f"CASE WHEN v < 12 THEN -v ELSE 0 END, {ball})"),
    ):
        sql = sql.replace(a, b)
    for end, way in (("min", ""), ("max", " DESC")):  # unknown teams last
        rank = ", ".join(c + way for c in ("frame_id", "ball_x", "ball_y", "ball_speed", "possession_team"))
        sql = re.sub(rf"arg_{end}\((\w+), frame_id\)", rf"first(\1 ORDER BY {rank} NULLS LAST)", sql)
    return sql


@pytest.mark.parametrize("name", ["player_obso", "shot_strikes", "states", "episode_embeddings", "episodes", "episode_outcomes", "episode_values", "dominant_phases", "snapshots", "episode_triggers"])
def test_rows_are_the_sqls_in_one_order_of_ties(spark, shared_ids, name):
    duck, folder = shared_ids
    found = plans.queries()[name](spark, folder)
    columns = sorted(found.columns)
    mine = sorted(map(repr, found.select(*columns).toArrow().to_pylist()))
    theirs = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({in_order(plans.oracle_sql()[name])})").to_arrow_table().to_pylist()))
    assert mine == theirs and mine


def test_ends_of_shared_ids(spark, shared_ids):
    """What attack_end_densities adds up; 400 frames have too few ends for a density."""
    duck, folder = shared_ids
    reason = "CASE WHEN nd IS NULL THEN 'match_end' WHEN nd THEN 'out_of_play' ELSE 'possession_change' END AS end_reason"
    sql = plans._with(f"SELECT match_id, period, episode_id, e.team AS possession_team, {reason}, l.bx AS end_ball_x, l.b_y AS end_ball_y FROM eps e JOIN lasts l USING (match_id, period, episode_id)", ("eps", "lasts"))
    found = plans.tracking.ends(plans._run_frames(spark, folder))
    columns = ", ".join(found.columns)
    mine = sorted(map(tuple, found.collect()))
    assert mine == sorted(duck.execute(f"SELECT {columns} FROM ({in_order(sql)})").fetchall()) and mine


@pytest.mark.parametrize("name", ["mean_positions", "obso_trajectory", "decisive_frames", "td_credit", "episode_summaries"])
def test_all_balls_count_where_matches_share_an_id(spark, shared_ids, name):
    test_rows_are_the_sqls_in_one_order_of_ties(spark, shared_ids, name)


def test_surface_of_a_frame_is_its_best_balls(spark):
    """A ball of both teams, one of a single team, and one of nobody, whose surface has the least control there is."""
    import math

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from touchline.operators import surfaces

    people = [("home", "a", 80.0, 30.0, 0.0, 0.0, 1), ("away", "b", 60.0, 40.0, 0.0, 0.0, 1)]
    rows = [("m", 1, 0, 1, "home", (70.0, 30.0), people), ("m", 1, 0, 1, "away", (70.0, 30.0), None), ("m", 1, 0, 1, "home", (90.0, 34.0), None), ("m", 1, 0, 2, None, (90.0, 34.0), people)]
    kind = "match_id string, period int, episode_id int, frame_id long, team string, ball struct<x double, y double>, players array<struct<team_id string, player_id string, x double, y double, vx double, vy double, n long>>"
    df = spark.createDataFrame(rows, kind)
    got = {r.frame_id: r for r in surfaces.ball_trajectory(df).collect()}
    each = surfaces.trajectory(df.filter("frame_id = 1").withColumn("players", F.first("players", True).over(Window.partitionBy("frame_id")))).collect()
    assert got[1].obso_max == max(r.obso_max for r in each) > 0.1
    assert 0 < got[2].obso_max < 1 / (1 + math.exp(30))
