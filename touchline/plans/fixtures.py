"""Adapter: football-shaped inputs from the star-schema test tables, in SQL that Spark and DuckDB both run.

The tables hold no matches, so events and nations are turned into actions and tracking rows by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPADL_SQL = """
SELECT concat('M', lpad(CAST(day(ts) AS VARCHAR(2)), 2, '0')) AS match_id,
  CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period,
  CAST((hour(ts) % 12) * 3600 + minute(ts) * 60 AS DOUBLE) AS time_seconds,
  event_id AS seq,
  CASE WHEN user_id % 22 < 11 THEN 'home' ELSE 'away' END AS team_id,
  concat('P', CAST(user_id % 22 AS VARCHAR(2))) AS player_id,
  ((event_id * 37) % 1051) / CAST(10 AS DOUBLE) AS start_x, ((event_id * 53) % 681) / CAST(10 AS DOUBLE) AS start_y,
  ((event_id * 37 + (event_id * 7) % 300) % 1051) / CAST(10 AS DOUBLE) AS end_x, ((event_id * 91) % 681) / CAST(10 AS DOUBLE) AS end_y,
  CASE event_type WHEN 'view' THEN 'pass' WHEN 'signup' THEN 'pass' WHEN 'click' THEN 'dribble' WHEN 'purchase' THEN 'shot'
    ELSE CASE event_id % 4 WHEN 0 THEN 'tackle' WHEN 1 THEN 'interception' WHEN 2 THEN 'clearance' ELSE 'foul' END END AS action_type,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'success' ELSE 'fail' END
       WHEN event_type IN ('view', 'signup', 'click') THEN CASE WHEN event_id % 5 <> 0 THEN 'success' ELSE 'fail' END END AS result,
  CASE event_id % 4 WHEN 0 THEN 'right_foot' WHEN 1 THEN 'left_foot' WHEN 2 THEN 'head' ELSE 'other' END AS bodypart
FROM {events}
"""

TRACKING_SQL = """
SELECT concat('T', lpad(CAST(m AS VARCHAR(3)), 2, '0')) AS match_id, CASE WHEN k < 1000 THEN 1 ELSE 2 END AS period, k + 1 AS frame_id, k / CAST(25 AS DOUBLE) AS time_seconds,
  CASE WHEN e < 22 THEN concat('P', lpad(CAST(e AS VARCHAR(2)), 2, '0')) END AS player_id,
  CASE WHEN e < 11 THEN 'home' WHEN e < 22 THEN 'away' END AS team_id,
  CASE WHEN e = 22 AND k % 300 BETWEEN 90 AND 99 THEN k % 300 / CAST(1 AS DOUBLE) WHEN NOT (e = 22 AND k % 300 BETWEEN 104 AND 111) THEN (CASE WHEN home = 1 THEN xi + CASE WHEN e = 22 THEN kick ELSE 0 END ELSE 1050 - xi - CASE WHEN e = 22 THEN kick ELSE 0 END END) / CAST(10 AS DOUBLE) END AS x,
  CASE WHEN e = 22 AND k % 300 BETWEEN 90 AND 99 THEN CAST(34 AS DOUBLE) ELSE (CASE WHEN home = 1 THEN yi ELSE 680 - yi END + CASE WHEN e = 22 THEN 4 ELSE 0 END) / CAST(10 AS DOUBLE) END AS y,
  e = 22 AS is_ball, NOT (e = 22 AND k % 300 BETWEEN 100 AND 111) AND NOT (k % 40 < 9 AND e = CAST(floor(k / 40) AS BIGINT) % 22) AS visible
FROM (SELECT m, k, e, p, home, 3 + greatest(k % 60 - 54, 0) * 8 AS kick, 50 + (s * 83) % 700 + w AS xi, 30 + (s * 173) % 560 + CAST(floor(v / 3) AS BIGINT) AS yi
  FROM (SELECT m, k, e, p, (p % 11) AS s, CASE WHEN p < 11 THEN 1 ELSE 0 END AS home, abs((k + p * 40) % 400 - 200) AS w, abs((k + p * 70) % 300 - 150) AS v
    FROM (SELECT m, k, e, CASE WHEN e = 22 THEN (CAST(floor(k / 60) AS BIGINT) * 7 + m) % 11 + CASE WHEN CAST(floor((k + m * 37) / 360) AS BIGINT) % 2 = 0 THEN 0 ELSE 11 END ELSE e END AS p
      FROM (SELECT CAST(floor(event_id / 2000) AS BIGINT) AS m, event_id % 2000 AS k FROM {events}) f
      CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS e FROM {nation} WHERE n_nationkey < 23) n) h) b) c
"""


def spadl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions: match_id, period, time_seconds, seq, team_id, player_id, coordinates, action_type, result, bodypart."""
    return spark.sql(SPADL_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of 22 players and the ball, 25 frames a second, two periods; spells of one team last up to 360 frames, players go out of
    sight now and then, the ball does, after a shot, and then has no x for a while. The nation table is the list of 23 entities."""
    return spark.sql(TRACKING_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
